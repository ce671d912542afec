"""Removal of repeated byte strings with suffix arrays.

Every string of ``LENGTH`` bytes holds an anchor: the smallest hash among its runs of ``RUN``
bytes, so that equal strings have equal anchors at equal places. Only anchors whose run stands in
several places matter; an anchor brings along the bytes around it that a string through it can
reach, its context. Equal contexts are counted, not gathered. The different contexts of one run meet
in a task, which sorts their suffixes in two stages and compares neighbours. A run with more
contexts than a task should hold is counted by narrow rows: ranges of its strings that agree in all bytes
as one, and one by one only the strings of ranges that agree in the middle but not in all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsprep.session import work_dir

from .common import batch, dropped, slices, stored, texts, written
from .neardup import mix

LENGTH, RUN = 200, 50
#: Bytes hashed at once, contexts of one run that a task compares, context bytes sorted and neighbours compared at once.
PIECE, CONTEXTS, SORTED, COMPARED = 1 << 18, 256, 500_000, 1 << 14
#: Ranges of the starts of strings of a run with more contexts, and rows that a task makes of them at a time.
RANGES, ROWS_AT_ONCE = 8, 20_000

_BASE = 0xC2B2AE3D27D4EB4F
_POWERS: list[np.ndarray] = []


def _hashes(b: np.ndarray, run: int) -> np.ndarray:
    """A mixed hash of each run of ``run`` bytes."""
    n = len(b)
    if not _POWERS or len(_POWERS[0]) < n + 1:
        inverse = pow(_BASE, -1, 1 << 64)
        _POWERS[:] = [np.cumprod(np.full(max(n, PIECE) + 1025, x, np.uint64)) for x in (_BASE, inverse)]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _POWERS[0][:n])))
    return mix((sums[run:] - sums[:-run]) * _POWERS[1][: n - run + 1])


def anchors(text: bytes, length: int = LENGTH, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors: the first smallest hash in each string of ``length`` bytes."""
    width = length - run + 1
    if len(text) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    places, values = [], []
    for at in range(0, len(text) - length + 1, PIECE):
        h = _hashes(np.frombuffer(text, np.uint8, min(len(text) - at, PIECE + length - 1), at), run)
        n = len(h) - width + 1
        # Place in the low bits: of equal hashes the first one counts.
        keyed = (h & ~np.uint64((1 << 20) - 1)) | np.arange(len(h), dtype=np.uint64)
        padded = np.concatenate((keyed, np.full(-len(h) % width, np.uint64(2**64 - 1)))).reshape(-1, width)
        left = np.minimum.accumulate(padded, axis=1).ravel()
        right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(right[:n], left[width - 1 : width - 1 + n])
        at_ = np.unique((least & np.uint64((1 << 20) - 1)).astype(np.int64))
        places.append(at_ + at)
        values.append(h[at_])
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(values)[first]


def _words(text: np.ndarray, kind: str) -> np.ndarray:
    """Eight bytes from every place on, as numbers."""
    return np.ndarray(len(text) - 7, kind, np.ascontiguousarray(text).data, strides=(1,))


def two_stage(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array of ``text`` to ``depth`` bytes.

    Suffixes smaller than their successors are sorted directly, eight bytes at a time. The others
    are induced: scanning the buckets of first bytes upwards, each suffix puts the one before it,
    if that is no smaller, at the next place of its bucket.
    """
    n = len(text)
    change = np.diff(text) != 0
    step = np.flatnonzero(change)  # last place of each run of one byte
    ahead = np.concatenate(([0], np.cumsum(change)))[:n]
    small = np.zeros(n, bool)
    if len(step):
        inner = ahead < len(step)
        small = inner & np.append(text[step] < text[step + 1], False)[ahead]  # the last run is followed by the end, the smallest
    padded = np.concatenate((text, np.zeros(depth + 16, np.uint8)))
    direct_ = np.flatnonzero(small)
    # Suffixes that agree to ``depth`` have one hash and stand together: one of each is sorted.
    hashes = _hashes(padded[: n + depth - 1], depth)[direct_]
    alike = np.argsort(hashes)
    new = np.ones(len(direct_), bool)
    new[1:] = hashes[alike[1:]] != hashes[alike[:-1]]
    heads_ = np.flatnonzero(new)
    copies = np.diff(np.append(heads_, len(direct_)))
    few = direct_[alike[heads_]]
    word = lambda at, every=_words(padded, ">u8"): every[at].astype(np.uint64)
    sorted_ = np.argsort(word(few), kind="stable")
    open_ = np.arange(len(few))  # places in the order that are not settled, and the groups of equal prefixes there
    head = np.ones(len(few), bool)
    if len(few):
        first = word(few[sorted_])
        head[1:] = first[1:] != first[:-1]
    for deep in range(8, depth, 8):
        alone = head & np.concatenate((head[1:], [True])) if len(head) else head
        open_, head = open_[~alone], head[~alone]
        if not len(open_):
            break
        keys, group = word(np.minimum(few[sorted_[open_]] + deep, n + depth)), np.cumsum(head) - 1
        other = keys != keys[head][group]
        if other.any():  # only groups with different words are sorted
            mixed = np.zeros(group[-1] + 1, bool)
            mixed[group[other]] = True
            some = np.flatnonzero(mixed[group])
            by = np.lexsort((keys[some], group[some]))
            sorted_[open_[some]] = sorted_[open_[some]][by]
            keys[some] = keys[some][by]
            head[1:] |= keys[1:] != keys[:-1]
    lengths = copies[sorted_]
    ends = np.cumsum(lengths)
    order = direct_[alike[np.arange(len(direct_)) + np.repeat(heads_[sorted_] - (ends - lengths), lengths)]]
    buckets: list[list[np.ndarray]] = [[] for _ in range(256)]
    firsts = np.searchsorted(text[order], np.arange(257))
    out = []

    def induce(found: np.ndarray, byte: int) -> np.ndarray:
        """Puts the suffixes before those in ``found`` into their buckets; returns those of the same bucket."""
        before = found[found > 0] - 1
        before = before[~small[before]]
        heads = text[before]
        same = before[heads == byte]
        for c in np.unique(heads[heads != byte]):
            buckets[c].append(before[heads == c])
        return same

    for byte in range(256):
        if byte == (text[-1] if n else -1):
            buckets[byte].insert(0, np.array([n - 1]))  # the last suffix follows the empty one
        todo = np.concatenate(buckets[byte]) if buckets[byte] else np.empty(0, np.int64)
        while len(todo):
            out.append(todo)
            todo = induce(todo, byte)
        direct = order[firsts[byte] : firsts[byte + 1]]
        if len(direct):
            out.append(direct)
            induce(direct, byte)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def repeated(text: np.ndarray, sizes: np.ndarray, at: np.ndarray, groups: np.ndarray, counts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The places where a string starts that repeats in its group, and the context of each, for contexts laid end to end.

    Contexts overlap in their texts, so equal strings count as two only if they lie equally far from
    the anchor in two contexts of one group, or in a context that counts twice.
    """
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    room = (starts + sizes)[owner] - np.arange(len(text))
    order = two_stage(text, length)
    order = order[room[order] >= length]  # a string stays within its context
    same = np.zeros(max(0, len(order) - 1), bool)
    if len(order):  # neighbours with a common prefix of ``length`` bytes, compared as rows of words
        strings = np.lib.stride_tricks.as_strided(text, (len(text) - length + 1, length), (1, 1))
        for start in range(0, len(same), COMPARED):
            part = order[start : start + COMPARED + 1]
            rows = strings[part]
            rows = rows.view("<u8") if length % 8 == 0 else rows
            same[start : start + len(part) - 1] = (rows[1:] == rows[:-1]).all(axis=1)
    found = np.zeros(len(text), bool)
    if len(order):
        string = np.cumsum(np.concatenate(([0], ~same)))
        shared = np.concatenate((same, [False])) | np.concatenate(([False], same))
        order, string = order[shared], string[shared]
        place = order - (starts + at)[owner[order]]
        group = groups[owner[order]]
        key = (string * (int(groups.max()) + 1) + group) * (2 * length) + place + length
        by = np.argsort(key)
        equal = key[by][1:] == key[by][:-1]
        found[order[by][:-1][equal]] = True
        found[order[by][1:][equal]] = True
    places = np.flatnonzero(found | (counts > 1)[owner] & (room >= length))
    return places - starts[owner[places]], owner[places]


ROWS = pa.schema([("row", pa.int64()), ("place", pa.int64()), ("run", pa.int64()), ("context", pa.int64())])


def _number(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every anchor with a hash of its run and one of its context."""
    for x in (part for whole in batches for part in slices(whole, "text")):
        out: list[list[np.ndarray]] = [[], [], [], []]
        for number, text in zip(x.column("row").to_pylist(), texts(x.column("text")), strict=True):
            place, value = anchors(text)
            lo, hi = np.maximum(place + RUN - LENGTH, 0), np.minimum(place + LENGTH, len(text))
            context = np.fromiter((_number(text[a:b]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)), np.int64, len(place))
            for column, value_ in zip(out, (np.full(len(place), number), place, value.view(np.int64), context), strict=True):
                column.append(value_)
        yield batch(ROWS, [np.concatenate(c) for c in out])


#: Texts are numbered by the part of the table that they were read in, in the high bits, and their place there.
PART_BITS = 33


def _beside(df: DataFrame, name: str) -> str:
    """Writes narrow rows with ``row`` by the part that their texts are in, so that texts need not be shuffled to meet them.

    A part holds no more rows than its texts have places.
    """
    path = work_dir(df.sparkSession, name)
    parts = df.withColumn("part", F.shiftright("row", PART_BITS)).repartition("part").sortWithinPartitions("part", "row")
    parts.write.partitionBy("part").parquet(path)
    return path


def _meeting(batches: Iterator[pa.RecordBatch], path: str, names: list[str]) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[list[np.ndarray]]]]:
    """Slices of texts, and for each text the columns of its rows in ``path``."""
    part, held = None, [np.zeros(0, np.int64) for _ in ("row", *names)]
    for x in (some for whole in batches for some in slices(whole, "text")):
        own: list[list[np.ndarray]] = []
        for row in x.column("row").to_pylist():
            if row >> PART_BITS != part:
                part = row >> PART_BITS
                tables = list(stored(f"{path}/part={part}"))
                held = [np.concatenate([t.column(c).to_numpy(zero_copy_only=False) for t in tables]) if tables else np.zeros(0, np.int64) for c in ("row", *names)]
                order = np.argsort(held[0], kind="stable")  # files of a part may come in any order
                held = [h[order] for h in held]
            a, b = np.searchsorted(held[0], (row, row + 1))
            own.append([h[a:b] for h in held[1:]])
        yield x, texts(x.column("text")), own


WANTED = ["place", "run", "context", "n", "large"]


def _contexts(path: str):
    """The bytes of the wanted contexts of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, plain, own in _meeting(batches, path, WANTED):
            data, columns = [], [[], [], [], []]
            for text, (place, runs, context, n, large) in zip(plain, own, strict=True):
                some = ~large.astype(bool)
                place = place[some]
                data += [text[max(p + RUN - LENGTH, 0) : p + LENGTH] for p in place.tolist()]
                for column, values in zip(columns, (runs[some], context[some], np.minimum(place, LENGTH - RUN), n[some]), strict=True):
                    column.append(values)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(np.concatenate(c).astype(np.int64)) for c in columns), pa.array(data, pa.binary())], names=["run", "context", "at", "n", "bytes"]
            )

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorts whole groups of contexts, as many at once as ``SORTED`` bytes; rows come ordered by group."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        run, context, group, at, n = (rows.column(c).to_numpy() for c in ("run", "context", "group", "at", "n"))
        data = rows.column("bytes").chunk(0) if rows.num_rows else pa.array([], pa.binary())
        sizes = pc.binary_length(data).to_numpy(zero_copy_only=False).astype(np.int64)
        offset = np.frombuffer(data.buffers()[1], np.int32)[data.offset] if len(data) else 0
        text = np.frombuffer(data.buffers()[2] or b"", np.uint8)[offset : offset + int(sizes.sum())]
        place, owner = repeated(text, sizes, at, np.unique(group, return_inverse=True)[1], n)
        # Starts in a row are one span: its first and last place relative to the anchor.
        new = np.ones(len(place), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(place)) - 1 if len(first) else first
        whose = owner[first]
        ends = np.stack((place[first] - at[whose], place[last] - at[whose]), axis=1).ravel()
        spans = pa.ListArray.from_arrays(pa.array(np.arange(0, len(ends) + 1, 2, dtype=np.int32)), pa.array(ends, pa.int64()))
        counts = np.bincount(whose, minlength=len(run))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), spans)
        return pa.RecordBatch.from_arrays([pa.array(run), pa.array(context), lists], names=["run", "context", "spans"])

    held: list[pa.RecordBatch] = []
    size = 0
    for x in batches:
        group = x.column("group").to_numpy()
        ends = np.flatnonzero(np.append(group[1:] != group[:-1], False)) + 1  # where a group of this batch ends; the last may go on
        total = np.cumsum(pc.binary_length(x.column("bytes")).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        if held and len(group) and size >= SORTED and held[-1].column("group")[-1].as_py() != group[0]:
            yield flush(held)
            held, size = [], 0
        while at < len(x):
            before = int(total[at - 1]) if at else 0
            far = ends[(ends > at) & (total[np.maximum(ends, 1) - 1] - before + size >= SORTED)]
            if not len(far):
                held.append(x.slice(at))
                size += int(total[-1]) - before
                break
            held.append(x.slice(at, int(far[0]) - at))
            yield flush(held)
            held, size, at = [], 0, int(far[0])
    if held:
        yield flush(held)


def _digest(path: str):
    """What is left of each text without the ranges that ``path`` has for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, plain, own in _meeting(batches, path, ["low", "high"]):
            out: list[list] = [[], [], [], [], []]
            for text, (low, high) in zip(plain, own, strict=True):
                order = np.argsort(low, kind="stable")
                low, high = low[order], np.minimum(high[order], len(text))
                reach = np.maximum.accumulate(high) if len(high) else high
                new = np.ones(len(low), bool)
                new[1:] = low[1:] > reach[:-1]  # touching ranges are one run
                first = np.flatnonzero(new)
                starts, ends = low[first], reach[np.append(first[1:], len(low)) - 1] if len(first) else first
                kept, at = hashlib.sha256(), 0
                for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                    kept.update(text[at:a])
                    at = b
                kept.update(text[at:])
                values = len(text), int((ends - starts).sum()), len(starts), kept.hexdigest(), np.stack((starts, ends), axis=1).tolist() if len(starts) else []
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [x.column("doc_id"), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string()), pa.array(out[4], pa.list_(pa.list_(pa.int64())))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
            )

    return run


def _edges() -> list[tuple[int, int]]:
    """The starts of strings before their anchor, 0 to ``LENGTH - RUN``, in ``RANGES`` ranges."""
    cuts = [i * (LENGTH - RUN + 1) // RANGES for i in range(RANGES + 1)]
    return [(a, b - 1) for a, b in zip(cuts, cuts[1:])]


def _pair(data: bytes) -> tuple[int, int]:
    digest = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


CORES = pa.schema([(c, pa.int64()) for c in ("run", "context", "n", "row", "place")] + [("range", pa.int32())] + [
    (c, pa.int64()) for c in ("core", "core2", "ext", "ext2")
])


def _cores(path: str):
    """For each context and range of starts a hash of the bytes that all strings of the range share, and one of all their bytes.

    Where the text ends within the range, the second stands for both with the text's own limits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, plain, own in _meeting(batches, path, WANTED):
            out: list[tuple] = []
            for row, text, columns in zip(x.column("row").to_pylist(), plain, own, strict=True):
                for place, number, context, n, large in zip(*(c.tolist() for c in columns), strict=True):
                    for part, (low, high) in enumerate(_edges() if large else ()):
                        last, first = min(high, place), max(low, place + LENGTH - len(text))
                        if first > last:
                            continue
                        core = _pair(text[place - low : place + LENGTH - high] if place >= low and place + LENGTH - high <= len(text) else b"")
                        ext = _pair(b"%d|%d|" % (first, last) + text[place - last : place + LENGTH - first])
                        out.append((number, context, n, row, place, part, *core, *ext))
                    if len(out) >= ROWS_AT_ONCE:
                        yield batch(CORES, list(zip(*out, strict=True)))
                        out.clear()
            yield batch(CORES, list(zip(*out, strict=True)) if out else [[]] * len(CORES))

    return run


STRINGS = pa.schema([("run", pa.int64()), ("range", pa.int32()), ("ext", pa.int64()), ("ext2", pa.int64()), ("n", pa.int64()), ("before", pa.int32()), ("hash", pa.int64()), ("hash2", pa.int64())])


def _strings(path: str):
    """Every string of the wanted ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, plain, own in _meeting(batches, path, ["place", "run", "range", "ext", "ext2", "n"]):
            out: list[tuple] = []
            for text, columns in zip(plain, own, strict=True):
                for place, number, part, ext, ext2, n in zip(*(c.tolist() for c in columns), strict=True):
                    low, high = _edges()[part]
                    for before in range(max(low, place + LENGTH - len(text)), min(high, place) + 1):
                        out.append((number, part, ext, ext2, n, before, *_pair(text[place - before : place - before + LENGTH])))
                    if len(out) >= ROWS_AT_ONCE:
                        yield batch(STRINGS, list(zip(*out, strict=True)))
                        out.clear()
            yield batch(STRINGS, list(zip(*out, strict=True)) if out else [[]] * len(STRINGS))

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of starts that touch or overlap as one, for every list of them."""
    for x in batches:
        lists = x.column("spans")
        owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        ends = lists.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)
        # Each list has a stretch of numbers of its own, so that one running maximum serves all.
        low, high = ends[:, 0] + owner * (4 * LENGTH), ends[:, 1] + owner * (4 * LENGTH)
        order = np.argsort(low, kind="stable")
        low, high, owner = low[order], np.maximum.accumulate(high[order]), owner[order]
        new = np.ones(len(low), bool)
        new[1:] = low[1:] > high[:-1] + 1
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(low)) - 1 if len(first) else first
        flat = (np.stack((low[first], high[last]), axis=1) - (owner[first] * (4 * LENGTH))[:, None]).ravel()
        spans = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 2, dtype=np.int32)), pa.array(flat, pa.int64()))
        ends_ = np.concatenate(([0], np.cumsum(np.bincount(owner[first], minlength=len(lists))))).astype(np.int32)
        yield pa.RecordBatch.from_arrays([x.column("run"), x.column("context"), pa.ListArray.from_arrays(pa.array(ends_), spans)], names=["run", "context", "spans"])


def _crowded(plain: DataFrame, wanted: str) -> DataFrame:
    """``run, context, spans`` of the contexts of runs that have too many for one task, by counting.

    Strings through an anchor are dealt into ranges by their start. Contexts that agree in all bytes of a range repeat there
    together; only where contexts share the middle of a range but not all of it are its strings counted
    one by one. Every row is narrow, and a context has at most ``LENGTH - RUN + 1`` of them.
    """
    kind = ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'bigint'}" for f in CORES)
    cores = written(plain.mapInArrow(_cores(wanted), kind), "cores")
    whole, middle = ["run", "range", "ext", "ext2"], ["run", "range", "core", "core2"]
    each = written(cores.groupBy(*whole, "core", "core2").agg(F.sum("n").alias("n"), F.min(F.struct("row", "place")).alias("one")), "ranges")
    mixed = written(each.groupBy(*middle).agg(F.count("*").alias("members")).where("members > 1"), "mixed")
    some = each.join(mixed, middle).select("one.row", F.col("one.place").alias("place"), *whole, "n")
    again = _beside(some.select("row", "place", *whole, "n"), "again")
    kind = ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'bigint'}" for f in STRINGS)
    strings = written(plain.mapInArrow(_strings(again), kind), "strings")
    key = ["run", "before", "hash", "hash2"]
    often = written(strings.groupBy(*key).agg(F.sum("n").alias("times")).where("times > 1").select(*key), "often")
    found = strings.join(often, key).select(*whole, F.col("before").cast("bigint").alias("low"), F.col("before").cast("bigint").alias("high"))
    edges = F.array(*[F.struct(F.lit(a).cast("bigint").alias("low"), F.lit(b).cast("bigint").alias("high")) for a, b in _edges()])
    # Where the text ends within a range, the range stands for the strings that it has.
    full = each.where("n > 1").join(mixed, middle, "left_anti").select(*whole, F.element_at(edges, F.col("range") + 1).alias("e")).select(*whole, "e.low", "e.high")
    spans = cores.join(found.unionAll(full), whole)
    lists = spans.groupBy("run", "context").agg(F.collect_list(F.array(-F.col("high"), -F.col("low"))).alias("spans"))  # of one context
    return lists.mapInArrow(_merged, "run bigint, context bigint, spans array<array<bigint>>")


def repeats(docs: DataFrame, text_col: str = "text", row_col: str = "row") -> DataFrame:
    """``row, low, high``: byte ranges of the rows covered by strings of ``LENGTH`` bytes that also start elsewhere.

    Rows are numbered as ``monotonically_increasing_id`` does. A row may come several times, or with overlapping ranges; a range may
    reach beyond the end of its text. Texts are never shuffled: what is asked of them is written beside each part of the table.
    """
    plain = docs.select(F.col(row_col).alias("row"), F.col(text_col).alias("text"))
    found = written(plain.mapInArrow(_anchors, "row bigint, place bigint, run bigint, context bigint"), "anchors")
    # Written tables on both sides of the joins: a run or context with many places is then dealt out as a skewed key.
    runs = found.groupBy("run").agg(F.count("*").alias("places"), (F.min("context") != F.max("context")).alias("differ")).where("places > 1")
    runs = written(runs.select("run", "differ"), "runs")
    several = written(found.join(runs, "run"), "several")
    dropped(found, runs)  # nothing reads them again
    # Different contexts: their bytes come from one place each.
    each = written(several.where("differ").groupBy("run", "context").agg(F.count("*").alias("n"), F.min(F.struct("row", "place")).alias("one")), "different")
    crowded = each.groupBy("run").agg(F.count("*").alias("members")).where(F.col("members") > CONTEXTS)
    wanted = each.join(written(crowded.select("run", F.lit(True).alias("large")), "crowded"), "run", "left").select(
        "one.row", F.col("one.place").alias("place"), "run", "context", "n", F.coalesce("large", F.lit(False)).alias("large"),
    )
    asked = _beside(wanted, "wanted")
    dropped(each)
    groups = plain.mapInArrow(_contexts(asked), "run bigint, context bigint, at bigint, n bigint, bytes binary")
    spans = "run bigint, context bigint, spans array<array<bigint>>"
    some = groups.withColumn("group", F.col("run")).repartition("group").sortWithinPartitions("group").mapInArrow(_compare, spans)
    some = some.unionAll(_crowded(plain, asked))
    some = written(some.where(F.size("spans") > 0), "repeats")
    # One context only, several times: all of it repeats, from its first byte to its last. Starts before the text stand for its first.
    place = F.col("place")
    equal = several.where("NOT differ").select("row", F.greatest(place - (LENGTH - RUN), F.lit(0)).alias("low"), (place + LENGTH).alias("high"))
    other = several.where("differ").join(some, ["run", "context"]).select("row", "place", F.explode("spans").alias("s"))
    return equal.unionAll(other.select("row", F.greatest(place + F.col("s")[0], F.lit(0)).alias("low"), (place + F.col("s")[1] + LENGTH).alias("high")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` of every row of ``docs``.

    A byte goes if a string of ``LENGTH`` bytes that also starts elsewhere covers it, in the same
    text or another, equal rows included. Null text is empty; shorter texts lose nothing. Rows are
    told apart by their number, so ids may repeat or be null. An empty table gives an empty
    result; other columns are ignored. ``spans`` are the removed byte ranges.
    """
    numbered = written(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row")), "texts", "zstd")
    found = _beside(repeats(numbered), "removed")
    kind = numbered.schema["doc_id"].dataType.simpleString()
    return numbered.mapInArrow(_digest(found), f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<array<bigint>>")
