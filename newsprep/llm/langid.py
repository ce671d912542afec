"""Language ID with hyperdimensional profiles.

Every letter class has a random vector of signs. An n-gram is the product of its letters' vectors,
each permuted by its place; a language's prototype is the sum over the n-grams of all its training
texts, without what the languages share. A text is the sum of its n-grams' vectors and goes to the
prototype with the highest cosine. Sums are linear: the dot product of a text with a prototype is
that of its n-grams, so each n-gram is compared once and a text adds up table entries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, written

#: Size of the vectors, letters of an n-gram, letter classes (0 is the gap between words), and the seed.
DIMENSIONS, N, CLASSES, SEED = 2048, 3, 128, 20240101
GRAMS = CLASSES**N


def _classes() -> np.ndarray:
    """Class of each code point: a-z and the small letters of Latin-1 each have one, other letters share 68 by number."""
    table = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            small = ord(char.lower()[0])
            table[point] = small - 96 if 97 <= small <= 122 else small - 196 if 223 <= small <= 255 else 60 + small % 68
    return table


_CLASS_OF: list[np.ndarray] = []


def class_table() -> np.ndarray:
    if not _CLASS_OF:
        _CLASS_OF.append(_classes())
    return _CLASS_OF[0]


def letters() -> np.ndarray:
    """The vectors of the classes."""
    return np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (CLASSES, DIMENSIONS))


def bind(codes: np.ndarray) -> np.ndarray:
    """The vectors of n-grams given by their codes."""
    base = letters()
    out = np.ones((len(codes), DIMENSIONS), np.int8)
    for place in range(N):  # the first letter is the most permuted
        out *= np.roll(base, N - 1 - place, axis=1)[codes // CLASSES ** (N - 1 - place) % CLASSES]
    return out


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all n-grams of a batch of texts, the text of each, and the letters of each text."""
    joined = [f" {x or ''} \0" for x in column.to_pylist()]
    points = np.frombuffer("".join(joined).encode("utf-32-le"), np.uint32)
    owner = np.cumsum(points == 0) - (points == 0)
    # A NUL inside a text would shift the owners; such texts are counted by length instead.
    lengths = np.fromiter(map(len, joined), np.int64, len(joined))
    if owner.size and owner[-1] != len(joined) - 1:
        owner = np.repeat(np.arange(len(joined)), lengths)
    kind = class_table()[points]
    keep = np.ones(len(kind), bool)
    keep[1:] = (kind[1:] != 0) | (kind[:-1] != 0) | (owner[1:] != owner[:-1])  # runs without letters are one gap
    kind, owner = kind[keep].astype(np.int64), owner[keep]
    n = np.bincount(owner[kind > 0], minlength=len(joined))
    if len(kind) < N:
        return np.empty(0, np.int64), np.empty(0, np.int64), n
    codes = sum(kind[i : len(kind) - N + 1 + i] * CLASSES ** (N - 1 - i) for i in range(N))
    same = (owner[: -N + 1] == owner[N - 1 :]) & (kind[1 : len(kind) - N + 2] > 0)
    return codes[same], owner[: -N + 1][same], n


def train(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and their unit prototypes, from every row whose language is not null.

    Tasks count n-grams by language and bundle the counted n-grams; what reaches the driver is one
    vector per language and shuffle partition.
    """
    labelled = rows.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for x in (part for whole in batches for part in slices(whole, "text")):
            codes, owner, _ = grams(x.column("text"))
            names = np.array(x.column("lang").to_pylist(), object)
            for lang in set(names):
                np.add.at(sums.setdefault(lang, np.zeros(GRAMS, np.int64)), codes[(names == lang)[owner]], 1)
        for lang, counts in sums.items():
            grams_ = np.flatnonzero(counts)
            for start in range(0, len(grams_), 1 << 16):
                at = grams_[start : start + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], names=["lang", "gram", "n"])

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for x in batches:
            names, codes, counts = np.array(x.column("lang").to_pylist(), object), x.column("gram").to_numpy(), x.column("n").to_numpy()
            for i in range(0, len(codes), 1024):
                vectors = bind(codes[i : i + 1024]).astype(np.float64)
                for lang in set(names[i : i + 1024]):
                    own = names[i : i + 1024] == lang
                    sums[lang] = sums.get(lang, 0) + counts[i : i + 1024][own] @ vectors[own]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([list(v) for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    counted = labelled.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    parts = counted.mapInArrow(bundle, "lang string, v array<double>")
    total: dict[str, np.ndarray] = {}
    for row in written(parts, "langid").toLocalIterator():
        total[row["lang"]] = total.get(row["lang"], 0) + np.array(row["v"])
    names = sorted(total)
    if not names:
        return [], np.zeros((0, DIMENSIONS))
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    profiles = unit(np.stack([total[x] for x in names]))
    return names, unit(profiles - profiles.mean(axis=0)) if len(names) > 1 else profiles


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", into: str = "language") -> DataFrame:
    """``docs`` with a struct ``into``: ``lang_pred, score``.

    Null texts, texts without a letter and every text of an untrained model are ``und`` with score
    0. The score is the share of the winner when the cosines are weighed by their exponentials; ties
    go to the first language by name. The norm of a text is that of its counts, which random
    vectors keep. Each row stands for itself; an existing column ``into`` is replaced.
    """
    names, prototypes = model
    shared = docs.sparkSession.sparkContext.broadcast(prototypes)  # languages times DIMENSIONS
    docs = docs.drop(into)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = np.zeros((GRAMS, len(names)), np.float32)
        known = np.zeros(GRAMS, bool)
        for x in (part for whole in batches for part in slices(whole, text_col)):
            codes, owner, n = grams(x.column(text_col))
            new = np.unique(codes[~known[codes]])
            for i in range(0, len(new), 1024):
                scores[new[i : i + 1024]] = bind(new[i : i + 1024]).astype(np.float32) @ shared.value.T.astype(np.float32)
            known[new] = True
            dots = np.stack([np.bincount(owner, scores[codes, k], len(n)) for k in range(len(names))], axis=1) if names else np.zeros((len(n), 0))
            pairs, repeats = np.unique(owner * GRAMS + codes, return_counts=True)
            norm = np.sqrt(DIMENSIONS * np.bincount(pairs // GRAMS, repeats.astype(np.float64) ** 2, len(n)))
            cosine = dots / np.maximum(norm, 1e-9)[:, None]
            weight = np.exp(8 * (cosine - cosine.max(axis=1, keepdims=True, initial=-1)))
            usable = (n > 0) & (len(names) > 0)
            best = cosine.argmax(axis=1) if names else np.zeros(len(n), int)
            score = np.where(usable, weight[np.arange(len(n)), best] / weight.sum(axis=1), 0.0) if names else np.zeros(len(n))
            found = [names[b] if u else "und" for b, u in zip(best, usable, strict=True)]
            struct = pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(score, pa.float64())], names=["lang_pred", "score"])
            yield pa.RecordBatch.from_arrays([*x.columns, struct], names=[*x.schema.names, into])

    kind = "struct<lang_pred: string, score: double>"
    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{into}` {kind}"]))


def held_out(key: Column) -> Column:
    """Every fifth id by checksum, null ids too: never learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(True))
