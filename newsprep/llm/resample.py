"""Importance resampling towards a target text, by array-scored weights and a distributed radix sort.

Features are runs of words, hashed into buckets. Two histograms, of the documents and of the target,
give one gain per bucket; the gains are an array, and a document's weight is the floored mean over
its features. Noise drawn from the id is added, and the highest scores are drawn without
replacement. The draw is ranked by sorting from the least significant digit: every pass counts the
digits of each chunk of rows, prefix sums over digits and chunks give each row its destination, and
the next pass takes the rows in that order. No task sees more than a chunk.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import PLAIN, batch, slices, texts, written

#: Bits of a sort digit, and bytes of text whose words are held at a time.
DIGIT_BITS, STRETCH = 12, 1 << 20
#: A chunk of the sort holds at least this power of two of rows; beyond as many chunks, chunks grow instead.
CHUNK_BITS = 15
#: The lowest whole number of 64 bits: with it, the order of signed numbers is that of their bits.
SIGN = -(1 << 63)


def hashed(text: bytes, grams: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Words and the buckets of all features of a text, stretch by stretch: a feature belongs to the stretch of its last word."""
    plain, at, tail = text.translate(PLAIN), 0, []
    while at < len(plain):
        end = plain.find(b" ", at + STRETCH)
        end = len(plain) if end < 0 else end
        new = plain[at:end].split()
        words, at = tail + new, end
        parts, run = [], list(map(crc32, words))
        for n in range(1, grams + 1):
            if n > 1:  # a checksum goes on from that of the words before
                run = list(map(crc32, words[n - 1 :], map(crc32, repeat(b" "), run)))
            parts.append(run[max(0, len(tail) - n + 1) :])
        yield len(new), np.concatenate([np.array(x, np.int64) for x in parts]) % buckets
        tail = words[len(words) - grams + 1 :] if grams > 1 else []


def histogram(docs: DataFrame, text_col: str, grams: int, buckets: int) -> np.ndarray:
    """Features by bucket over the whole table; each task sends its own sums, ``buckets`` rows at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for x in (part for whole in batches for part in slices(whole, text_col)):
            found = [b for text in texts(x.column(text_col)) for _, b in hashed(text, grams, buckets)]
            if found:
                sums += np.bincount(np.concatenate(found), minlength=buckets)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    counted = docs.select(text_col).mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    for row in counted.collect():  # one row per bucket
        out[row["bucket"]] = row["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """How much likelier each bucket is in the target than in the raw documents: a smoothed logarithm of the ratio, floored."""
    raw_all, target_all, n = float(raw.sum()), float(target.sum()), len(raw)
    return np.array([
        math.floor(scale * math.log((float(t) + 1) * (raw_all + n) / ((float(s) + 1) * (target_all + n)))) for s, t in zip(raw, target, strict=True)
    ], np.int64)


def noise(key: str, seed: int, scale: int = 1000) -> int:
    """The Gumbel noise of an id, floored: the highest sums are a draw in proportion to the exponentials of the weights."""
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-scale * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, gain: np.ndarray, grams: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """``row, doc_id, n_words, n_features, weight, score`` of every row, as a table; ``row`` is unique."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number per bucket
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "n_features", "weight", "score"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for x in (part for whole in batches for part in slices(whole, "text")):
            out = [[], [], [], [], []]
            for key, text in zip(x.column("doc_id").to_pylist(), texts(x.column("text")), strict=True):
                words = n = total = 0
                for some, found in hashed(text, grams, len(table)):
                    words, n, total = words + some, n + len(found), total + int(table[found].sum())
                weight = total // n if n else 0
                for column, value in zip(out, (key, words, n, weight, weight + noise("" if key is None else str(key), seed)), strict=True):
                    column.append(value)
            yield batch(schema, out)

    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    found = narrow.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")
    return written(found.withColumn("row", F.monotonically_increasing_id()), "weights")


def digits(df: DataFrame, keys: list[Column]) -> list[Column]:
    """The digits of a composite key, the least significant first.

    ``keys`` are 64-bit numbers, the most significant first, each ascending, nulls last. Leading
    bits in which the least and the greatest value agree are the same in all rows and have no digit.
    """
    ends = df.agg(*[f(k).alias(f"{n}{i}") for i, k in enumerate(keys) for n, f in (("a", F.min), ("b", F.max))],
                  *[F.count_if(k.isNull()).alias(f"n{i}") for i, k in enumerate(keys)]).first()
    found = []
    for i in reversed(range(len(keys))):
        low, high = ends[f"a{i}"], ends[f"b{i}"]
        bits = 0 if low is None else ((low ^ SIGN) ^ (high ^ SIGN)).bit_length() if (low < 0) == (high < 0) else 64
        plain = F.coalesce(keys[i].bitwiseXOR(F.lit(SIGN)), F.lit(0))
        found += [F.shiftrightunsigned(plain, at).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1)).cast("int") for at in range(0, bits, DIGIT_BITS)]
        if ends[f"n{i}"]:
            found.append(keys[i].isNull().cast("int"))
    return found


def _placer(names: list[str], row: str, bits: int, base: np.ndarray):
    """Moves the rows of a chunk to their places, given the first place of each digit and the rows of it in earlier chunks."""

    def place(rows: pa.Table, before: pa.Table) -> pa.Table:
        slot = rows.column(row).to_numpy() & ((1 << bits) - 1)
        at = np.full(1 << bits, -1, np.int32)
        at[slot] = np.arange(len(slot))
        at = at[at >= 0]  # the rows of the chunk in their order
        digit = rows.column("_digit").to_numpy()[at].astype(np.uint16)
        first = base.copy()
        first[before.column("_digit").to_numpy()] += before.column("_before").to_numpy()
        count = np.bincount(digit, minlength=len(base))
        to = np.argsort(digit, kind="stable")  # 16-bit numbers: a counting sort by bytes
        within = np.arange(len(to)) - np.repeat(np.cumsum(count) - count, count)
        kept = rows.select(names).take(pa.array(at[to]))
        return kept.set_column(names.index(row), row, pa.array(first[digit[to]] + within))

    return place


def radix_sorted(df: DataFrame, keys: list[Column], row: str = "row") -> DataFrame:
    """``df`` with ``row``, a unique number not below 0, replaced by the place in the order of ``keys``, from 0.

    Rows that agree in all keys keep the order of ``row``. Each pass shuffles the rows once, to
    their chunks; a chunk holds at most a power of two of rows, whatever the keys. The counts of a
    pass are prefix sums within each digit; only one total per digit reaches the driver.
    """
    n = df.count()
    if n == 0:
        return df
    bits = max(CHUNK_BITS, (n >> CHUNK_BITS).bit_length())
    chunk = F.shiftright(F.col(row), bits).alias("_chunk")
    names = df.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    passes = digits(df, keys) or [F.lit(0)]
    for digit in passes:
        source = df.withColumns({"_chunk": chunk, "_digit": digit})
        counts = written(source.groupBy("_chunk", "_digit").agg(F.count("*").alias("_n")), "radix-counts")
        totals = np.zeros(1 << DIGIT_BITS, np.int64)
        for r in counts.groupBy("_digit").agg(F.sum("_n").alias("n")).collect():  # one row per digit value
            totals[r["_digit"]] = r["n"]
        earlier = W.partitionBy("_digit").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
        offsets = counts.select("_chunk", "_digit", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))

        placed = source.groupBy("_chunk").cogroup(offsets.groupBy("_chunk")).applyInArrow(_placer(names, row, bits, np.cumsum(totals) - totals), kinds)
        df = written(placed, "radix")
    return df


def resample(
    docs: DataFrame, target: DataFrame, share: tuple[int, int] = (25, 100), least_words: int = 20, grams: int = 2, buckets: int = 10_000, seed: int = 7,
    id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs``; ``rank`` is null where a row is not drawn.

    Of the N rows with at least ``least_words`` words the ``floor(share[0] * N / share[1])`` highest
    scores are drawn, ties to the smaller id, null ids last; rows that agree in both are ranked in
    the order in which they are read. Null and empty texts have no features and weight 0. Repeated
    rows count and are ranked as often as they stand. With an empty target every bucket counts as
    equally likely in it; an empty table gives an empty result. Ids are whole numbers; other columns are ignored.
    """
    wanted = histogram(target, target_text, grams, buckets)
    scored = weighed(docs, gains(histogram(docs, text_col, grams, buckets), wanted), grams, seed, id_col, text_col)
    able = F.col("n_words") >= least_words
    # Scores are thousandths of logarithms of 64-bit counts: some 200,000 values at most, whatever the table.
    tally = sorted(((r["score"], r["n"]) for r in scored.where(able).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    draw, above, cut = share[0] * sum(n for _, n in tally) // share[1], 0, None
    for score, n in tally:
        if above >= draw:
            break
        above, cut = above + n, score
    within = able & (F.col("score") >= F.lit(cut)) if cut is not None else F.lit(False)
    # Whoever is below the cut cannot be drawn; equal scores at the cut are decided by the sort.
    ranked = radix_sorted(scored.where(within), [F.bitwise_not("score"), F.col("doc_id")])
    rank = F.when(F.col("row") < draw, F.col("row") + 1)
    columns = ["doc_id", "n_features", "weight", "score"]
    rest = scored.where(~within).select(*columns, F.lit(None).cast("bigint").alias("rank"))
    return ranked.select(*columns, rank.alias("rank")).unionAll(rest)
