"""Near duplicates by HyperMinHash registers, banding, estimation and verification on full sets.

A document is the set of its shingles, as 64-bit hashes. Equal sets are one class from the start.
Each of ``REGISTERS`` buckets keeps the smallest hash that falls into it, compressed to its leading
zeros and ``MANTISSA`` bits; buckets that a short text leaves empty are filled by further rounds of
hashing, so that every register agrees with probability equal to the similarity. Bands of registers
bring candidates together; a pair needs an estimate near the threshold, corrected for accidental
agreement of compressed registers, and is then compared on the full sets.

In a band each class is first compared with the smallest id only. Where one of these comparisons
fails, all classes of the band are compared in blocks of bounded size inside tasks, which return
the links of a spanning forest: no pairs become rows, and no link that joins two parts is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, MASK, texts, written

#: Words of a shingle and percent of the union, unless the caller says otherwise.
WORDS, THRESHOLD = 3, 85
REGISTERS, MANTISSA, ROUNDS = 128, 10, 24
#: Two texts at the threshold share no band with this chance at most.
MISS = 4.5e-7
#: Below the threshold by more standard deviations of the estimate than this a pair is not compared.
DEVIATIONS = 5.4
#: Classes and shingles of a block in which all classes are compared.
BLOCK, BLOCK_SHINGLES = 1024, 500_000
#: Bytes of text hashed at once.
PIECE = 1 << 19

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        _POWERS[:] = [np.cumprod(np.full(max(n, PIECE), b, np.uint64)) for b in (_BASE, inverse)]
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words between blanks, in order."""
    parts, at = [], 0
    while at < len(text):
        end = len(text)
        if end - at > PIECE:  # cut at a blank; a longer word stays whole
            cut = [p for c in b" \t\n\x0b\x0c\r" if (p := text.rfind(bytes([c]), at, at + PIECE)) > at]
            nexts = [p for c in b" \t\n\x0b\x0c\r" if (p := text.find(bytes([c]), at + PIECE)) > 0]
            end = max(cut) if cut else min(nexts, default=end)
        b = np.frombuffer(text, np.uint8, end - at, at)
        solid = ~((b == 32) | ((b >= 9) & (b <= 13)))
        edges = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False])).view(np.int8)))
        powers, inverse = _powers(len(b) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers[:-1])))
        parts.append(mix((sums[edges[1::2]] - sums[edges[::2]]) * inverse[edges[::2]]))
        at = end
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The distinct shingles, sorted; the whole sequence as one if there are fewer words."""
    w = word_hashes(text.translate(LOWER))
    if not len(w):
        return w
    n = min(words, len(w))
    runs = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        runs = mix(runs * np.uint64(_BASE) + w[i : len(w) - n + 1 + i])
    return np.unique(runs)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """The compressed registers of every set; zeros for an empty set."""
    full = np.uint64(MASK)
    low = np.full((len(sets), REGISTERS), full)
    when = np.zeros((len(sets), REGISTERS), np.uint32)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    items = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    for step in range(ROUNDS):
        h = mix(items + np.uint64(step * 0xD1B54A32D192ED03 & MASK))
        fresh = np.full(len(sets) * REGISTERS, full)
        np.minimum.at(fresh, owner * REGISTERS + (h & np.uint64(REGISTERS - 1)).astype(np.int64), h >> np.uint64(7))
        fresh = fresh.reshape(low.shape)
        gain = (low == full) & (fresh != full)
        low[gain], when[gain] = fresh[gain], step
        open_ = (low == full).any(axis=1) & (sizes > 0)
        if not open_.any():
            break
        some = open_[owner]
        items, owner = items[some], owner[some]
    for d in np.flatnonzero((low == full).any(axis=1) & (sizes > 0)):  # each last bucket has a hash of its own
        empty = np.flatnonzero(low[d] == full)
        seeds = mix(empty.astype(np.uint64) + np.uint64(1 << 32))
        low[d, empty] = np.minimum.reduce(mix(sets[d][:, None] + seeds[None, :]) >> np.uint64(7), axis=0)
        when[d, empty] = ROUNDS
    zeros = 57 - np.frexp(low.astype(np.float64))[1].clip(0, 57)
    shifted = low << (zeros.astype(np.uint64) + np.uint64(1))
    mantissa = (shifted >> np.uint64(57 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
    out = (when << np.uint32(16)) | (zeros.astype(np.uint32) << np.uint32(10)) | mantissa.astype(np.uint32)
    out[sizes == 0] = 0
    return out


def rows_of(threshold: int) -> int:
    """Registers in a band: as many as ``MISS`` allows, 5 at 85 percent and 4 at 80."""
    misses = lambda r: (1 - (threshold / 100) ** r) ** (REGISTERS // r)
    return max((r for r in range(1, REGISTERS + 1) if misses(r) <= MISS), default=1)


def margin(threshold: int) -> float:
    return DEVIATIONS * (threshold / 100 * (1 - threshold / 100) / REGISTERS) ** 0.5 + 1e-9


def bands(sketch: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    rows = rows_of(threshold)
    keys = np.empty((len(sketch), REGISTERS // rows), np.uint64)
    for band in range(keys.shape[1]):
        key = np.full(len(sketch), band + 1, np.uint64)
        for r in range(rows):
            key = mix(key * np.uint64(_BASE) + sketch[:, band * rows + r])
        keys[:, band] = key
    return keys.view(np.int64)


def estimate(same: Column) -> Column:
    """Similarity from the number of equal registers: agreement by chance, same zeros (1/3) and same mantissa, is taken out."""
    chance = 1 / 3 / 2**MANTISSA
    return (same / F.lit(float(REGISTERS)) - F.lit(chance)) / F.lit(1 - chance)


def _features(batches: Iterator[pa.RecordBatch], words: int, threshold: int) -> Iterator[pa.RecordBatch]:
    for x in batches:
        for at in range(0, len(x), 128):
            part = x.slice(at, 128)
            sets = [shingles(t, words) for t in texts(part.column("text"))]
            sketch = registers(sets)
            ints = lambda m, kind: pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], pa.array(m.ravel(), kind))
            signed = lambda f: pa.array(np.array([f(s) for s in sets], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                signed(lambda s: s.sum(dtype=np.uint64)), signed(lambda s: np.bitwise_xor.reduce(mix(s), initial=np.uint64(0))),
                ints(bands(sketch, threshold), pa.int64()), ints(sketch.astype(np.int32), pa.int32()),
            ], names=["doc_id", "n", "sum", "xor", "bands", "registers"])


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for x in batches:
        for at in range(0, len(x), 256):
            part = x.slice(at, 256)
            sets = [shingles(t, words).view(np.int64) for t in texts(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "shingles"])


def linked(sets: list[np.ndarray], threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets of one block, found on the full sets."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    every, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = np.cumsum(count > 1) - 1  # a shingle of one set only is in no intersection
    keep = count[inverse] > 1
    owner, column = owner[keep], shared[inverse[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    total = int(column[-1]) + 1 if len(column) else 0
    for start in range(0, total, 2048):
        a, b = np.searchsorted(column, [start, start + 2048])
        present = np.zeros((len(sets), min(2048, total - start)), np.float32)
        present[owner[a:b], column[a:b] - start] = 1
        common += present @ present.T
    union = sizes[:, None] + sizes[None, :] - common
    link = (100 * common.astype(np.float64) >= threshold * union) & (union > 0)
    seen, forest = np.zeros(len(sets), bool), []
    for root in range(len(sets)):
        if seen[root]:
            continue
        seen[root], todo = True, [root]
        while todo:
            x = todo.pop()
            for y in np.flatnonzero(link[x] & ~seen).tolist():
                seen[y] = True
                forest.append((x, y))
                todo.append(y)
    return forest


def _block(rows: pd.DataFrame, threshold: int) -> pd.DataFrame:
    ids = rows["doc_id"].to_numpy()
    pairs = linked([np.asarray(s, np.int64) for s in rows["shingles"]], threshold)
    return pd.DataFrame({"a": [ids[x] for x, _ in pairs], "b": [ids[y] for _, y in pairs]}, dtype="int64")


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of the nodes in ``edges(a, b)``: the smallest node each can reach.

    Large and small stars in turn: each node's neighbours are tied to the smallest of them, until
    nothing changes. Only minima are gathered per node, so a node with many links is no burden.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars")
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        after = written(small.where("u <> v").distinct(), "stars")
        mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark(after) == mark(now):
            return after.select(F.col("u").alias("node"), F.col("v").alias("component"))
        now = after


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs``.

    Two documents are linked if their sets share ``threshold`` percent of the union of their
    shingles of ``words`` words; a component is
    named by its smallest id. Null texts and texts without words have no shingles, are linked with
    nothing and are kept. A row without id is linked with nothing, has no component and is kept.
    Rows that share an id are one document with several texts. Ids are whole numbers. An empty
    table gives an empty result; other columns are ignored.
    """
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    features = written(plain.mapInArrow(lambda x: _features(x, words, threshold), "doc_id bigint, n bigint, sum bigint, xor bigint, bands array<bigint>, registers array<int>"), "features")
    narrow = features.select("doc_id", "n", "sum", "xor")
    some = narrow.where("n > 0 AND doc_id IS NOT NULL")
    classes = written(some.groupBy("sum", "xor", "n").agg(F.min("doc_id").alias("rep")), "classes")
    reps = classes.select(F.col("rep").alias("doc_id")).distinct()
    sketches = features.join(reps, "doc_id", "left_semi").where("n > 0").select("doc_id", "n", "registers", "bands")
    rows = written(sketches.select("doc_id", "n", F.explode("bands").alias("band")), "bands")
    stars = rows.groupBy("band").agg(F.min("doc_id").alias("pivot"), F.count("*").alias("members"), F.sum("n").alias("shingles")).where("members > 1")
    grouped = written(rows.join(stars, "band"), "candidates")
    pairs = grouped.where("doc_id <> pivot").select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")).distinct()
    sketch = features.where("n > 0").select("doc_id", "registers")
    same = F.aggregate(F.zip_with("ra", "rb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    likely = written(
        pairs.join(sketch.select(F.col("doc_id").alias("a"), F.col("registers").alias("ra")), "a")
        .join(sketch.select(F.col("doc_id").alias("b"), F.col("registers").alias("rb")), "b")
        .where(estimate(same) >= threshold / 100 - margin(threshold)).select("a", "b").distinct(), "likely"
    )
    # Bands in which a class may have no link with the pivot are compared in full; pairs that the estimate drops count too.
    wanted = grouped.where("members > 2").select("doc_id").unionAll(likely.select("a")).unionAll(likely.select("b")).distinct()
    sets = written(plain.join(wanted, "doc_id", "left_semi").mapInArrow(lambda x: _sets(x, words), "doc_id bigint, shingles array<bigint>"), "sets")
    side = lambda name: sets.select(F.col("doc_id").alias(name), F.col("shingles").alias(f"s{name}"))
    shared = F.size(F.array_intersect("sa", "sb"))
    links = written(
        likely.join(side("a"), "a").join(side("b"), "b")
        .where(shared * 100 >= (F.size("sa") + F.size("sb") - shared) * threshold).select("a", "b").distinct(), "links"
    )
    large = grouped.where("members > 2")
    failed = large.where("doc_id <> pivot").join(
        links.select(F.col("a").alias("doc_id"), F.col("b").alias("pivot")), ["doc_id", "pivot"], "left_anti"
    ).select("band").distinct()
    parts = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    blocks = (
        large.join(failed, "band", "left_semi").withColumn("parts", parts).withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("doc_id", "band", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    )
    more = blocks.join(sets, "doc_id").groupBy("band", "x", "y").applyInPandas(lambda x: _block(x, threshold), "a bigint, b bigint")
    found = components(links.unionAll(more))
    named = classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
        "sum", "xor", "n", F.coalesce("component", "rep").alias("component_id")
    )
    result = narrow.join(named, ["sum", "xor", "n"], "left")
    component = F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id"))
    return result.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with all its columns, one row of each component; rows without id stay, repeated rows of one id and text stay once."""
    gone = near_duplicates(docs, id_col, text_col, words, threshold).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    left = docs.join(gone, F.col(id_col).cast("bigint") == F.col("_gone"), "left_anti")
    named = left.where(F.col(id_col).isNotNull()).dropDuplicates([id_col, text_col])
    return named.unionByName(left.where(F.col(id_col).isNull()))
