"""Benchmark decontamination: one automaton over the normalised items, each text scanned once."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsprep.session import work_dir

from .common import PLAIN, batch, slices, stored, texts, written

#: Characters of patterns in one automaton; more items make further automata.
BLOCK = 4_000_000

#: Automata that a worker holds at a time, and bytes of text scanned by some before the next are built.
HELD, STRETCH = 2, 1 << 24
#: Those it holds, by the names of their blocks.
_BUILT: dict[str, ahocorasick.Automaton] = {}


def windows(text: bytes, words: int) -> set[str]:
    """The patterns of an item: runs of ``words`` words, or all its words if it has fewer."""
    found = text.translate(PLAIN).split()
    runs = [found[i : i + words] for i in range(max(1, len(found) - words + 1))] if found else []
    # One character per byte, a blank around every word, so that matches begin and end at words.
    return {f" {b' '.join(run).decode('latin-1')} " for run in runs}


class Block:
    """Patterns of one automaton, in the shared folder, with the items that hold them."""

    def __init__(self, path: str):
        self.path = path

    @property
    def value(self) -> dict[str, list[str]]:
        found: dict[str, list[str]] = {}
        for x in stored(self.path):
            for pattern, owner in zip(x.column("pattern").to_pylist(), x.column("owner").to_pylist(), strict=True):
                found.setdefault(pattern, []).append(owner)
        return found


def blocks(items: DataFrame, id_col: str, text_col: str, words: int, limit: int = BLOCK) -> list[tuple[str, Block]]:
    """The patterns of all items, cut and dealt by their hash into blocks of about ``limit`` characters, written to the shared folder; each with a name."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in (part for whole in batches for part in slices(whole, "text")):
            pairs = [(p, owner or "") for owner, text in zip(x.column("owner").to_pylist(), texts(x.column("text")), strict=True) for p in windows(text, words)]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], names=["pattern", "owner"])

    narrow = items.select(F.col(id_col).cast("string").alias("owner"), F.col(text_col).alias("text"))
    patterns = written(narrow.mapInArrow(cut, "pattern string, owner string").distinct(), "patterns")
    n = -(-(patterns.agg(F.sum(F.length("pattern"))).first()[0] or 0) // limit)
    if not n:
        return []
    path = work_dir(items.sparkSession, "blocks")
    patterns.withColumn("block", F.pmod(F.xxhash64("pattern"), F.lit(n))).repartition("block").write.partitionBy("block").parquet(path)
    return [(f"{path}/block={i}", Block(f"{path}/block={i}")) for i in range(n)]


def scan(text: bytes, automata: list) -> tuple[int, np.ndarray, set[str], np.ndarray, np.ndarray]:
    """Words, hit flags, items, and where each word begins and ends in the original bytes."""
    plain = np.frombuffer(text.translate(PLAIN), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([False], plain, [False])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    items: set[str] = set()
    hit = np.zeros(len(starts) + 1, np.int32)
    if len(starts):
        line = f" {b' '.join(text.translate(PLAIN).split()).decode('latin-1')} "
        # Where word i begins in the line: the words before it and one blank each.
        places = 1 + np.concatenate(([0], np.cumsum(ends - starts + 1)[:-1]))
        for automaton in automata:
            for end, (length, n, owners) in automaton.iter(line):
                first = int(np.searchsorted(places, end - length + 2))
                hit[first] += 1
                hit[first + n] -= 1
                items.update(owners)
    return len(starts), np.cumsum(hit[:-1]) > 0, items, starts, ends


def stretches(text: bytes, hit: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """The stretches of hit words as code points of the original text, by one running count of its code points."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).view(np.int8)))
    points = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80, dtype=np.int32)))
    return np.stack((points[starts[edges[::2]]], points[ends[edges[1::2] - 1]]), axis=1).tolist()


def _automata(shared: list[tuple[str, Block]]) -> list[ahocorasick.Automaton]:
    """The automata of blocks, given with names of their own; each is built once per worker, all others are let go."""
    wanted = {name for name, _ in shared}
    for name in _BUILT.keys() - wanted:
        del _BUILT[name]
    for name, block in shared:
        patterns = block.value if name not in _BUILT else None
        if patterns:
            automaton = ahocorasick.Automaton()
            for pattern, owners in patterns.items():
                automaton.add_word(pattern, (len(pattern), pattern.count(" ") - 1, sorted(set(owners))))
            automaton.make_automaton()
            _BUILT[name] = automaton
    return [_BUILT[name] for name, _ in shared if name in _BUILT]


RESULT = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.list_(pa.int32())))])


def decontaminate(
    docs: DataFrame, items: DataFrame, words: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", into: str = "found"
) -> DataFrame:
    """``docs`` with a struct ``into``: ``n_words, n_hit, items, spans``.

    A word is hit if it lies in an occurrence of a window of an item. ``items`` are the sorted ids,
    ``spans`` the hit stretches as code points of the original text. Null or wordless texts hold no
    words; an item without words has no window; an item without id counts under the empty id;
    repeated items count once. With no items nothing is hit. An existing column ``into`` is replaced.

    Patterns are cut by tasks and written in blocks of ``BLOCK`` characters; a worker reads a block
    and builds its automaton once. With more than ``HELD`` blocks a stretch of texts is scanned by
    ``HELD`` automata after the other, so neither the driver nor a worker holds the whole benchmark.
    """
    shared = blocks(items, item_id, item_text, words)
    groups = [shared[i : i + HELD] for i in range(0, len(shared), HELD)] or [[]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in (part for whole in batches for part in slices(whole, text_col, STRETCH)):
            plain = texts(x.column(text_col))
            hits: list[np.ndarray | None] = [None] * len(plain)
            owners: list[set[str]] = [set() for _ in plain]
            rows = []
            for i, group in enumerate(groups):
                automata, last = _automata(group), i == len(groups) - 1
                for at, text in enumerate(plain):
                    n, hit, found, starts, ends = scan(text, automata)
                    owners[at] |= found
                    if found:
                        hits[at] = hit if hits[at] is None else hits[at] | hit
                    if last:
                        hit = hits[at]
                        rows.append((n, 0 if hit is None else int(hit.sum()), sorted(owners[at]), [] if hit is None else stretches(text, hit, starts, ends)))
            result = batch(RESULT, list(zip(*rows, strict=True)) if rows else [[]] * 4)
            yield pa.RecordBatch.from_arrays([*x.columns, pa.StructArray.from_arrays(result.columns, fields=list(RESULT))], names=[*x.schema.names, into])

    docs = docs.drop(into)
    kind = "struct<n_words: bigint, n_hit: bigint, items: array<string>, spans: array<array<int>>>"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{into}` {kind}"])
    return docs.mapInArrow(run, schema)
