"""Text quality by pairwise ranking: a Bradley-Terry model whose scores are learned from preferences.

A document has a row of features. Of a good and a bad document the good one is preferred, with the
logistic of the difference of their scores; the scores are linear in the features, so the loss is
logistic in the differences of features. The threshold is a quantile of the learned scores: as
large a share of the labelled documents as is bad lies below it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, slices, texts

#: Bytes of a text whose words are held at a time; labelled documents of each class that are learned from; pairs; weight of the penalty.
STRETCH, SAMPLE, PAIRS, PENALTY = 1 << 20, 5_000, 50_000, 1e-3
NAMES = (
    "length", "symbols", "exclamations", "capitals", "digits", "punctuation", "letters_per_word", "variety", "commonest", "stutter",
    "repeated_runs", "repeated_lines", "open_lines", "wordless", "shouted", "long_words", "white",
)
_KINDS = bytes(
    32 if c <= 32 else 65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 0xC0 else 48 if 48 <= c <= 57 else 33 if c == 33
    else 46 if chr(c) in ".,;:?'\"()-" else 126 if c >= 0x80 else 35 for c in range(256)
)
_WORDLESS = re.compile(rb"(?<!\S)[^aA0~\s]+(?!\S)")
_SHOUTED = re.compile(rb"(?<!\S)[^a\s]*A[^a\s]*A[^a\s]*(?!\S)")


def stretches(text: bytes) -> Iterator[bytes]:
    """The text in parts of about ``STRETCH`` bytes, cut at blanks."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + STRETCH)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def _part(text: bytes) -> tuple[int, np.ndarray]:
    kinds = text.translate(_KINDS)
    count = np.bincount(np.frombuffer(kinds, np.uint8), minlength=256)
    points = max(1, len(text) - int(count[126]))  # bytes that go on with a code point are not counted
    letters = max(1, int(count[65] + count[97]))
    words = text.translate(LOWER).split()
    n = len(words)
    some = max(1, n)
    tally = Counter(words)
    runs = list(zip(words, words[1:], words[2:], strict=False))
    lines = [x.strip() for x in text.split(b"\n") if x.strip()]
    size = max(1, sum(map(len, lines)))
    return n, np.array([
        0.0, count[35] / points, count[33] / points, count[65] / letters, count[48] / points, count[46] / points,
        (points - count[32]) / some, math.log(max(1, len(tally))) / math.log(n) if n > 1 else 1.0,
        max(tally.values(), default=0) / some if n > 9 else 0.0, sum(map(eq, words, words[1:])) / some,
        1 - len(set(runs)) / len(runs) if runs else 0.0, 1 - sum(map(len, set(lines))) / size if lines else 0.0,
        sum(len(x) for x in lines if x[-1:] not in b".!?:\"')") / size, len(_WORDLESS.findall(kinds)) / some, len(_SHOUTED.findall(kinds)) / some,
        sum(len(w) > 30 for w in tally) / some, count[32] / points,
    ])


def features(text: bytes) -> np.ndarray:
    """The features of a whole text; those of a text of several stretches are their mean, weighed by words."""
    parts = [_part(x) for x in stretches(text)]
    words = sum(n for n, _ in parts)
    out = sum(((n or 1) * x for n, x in parts), np.zeros(len(NAMES))) / max(1, sum(n or 1 for n, _ in parts))
    out[0] = math.log1p(words)
    return out


@dataclass(frozen=True)
class Model:
    """Scores are ``weights * (features - centre) / scale``; ``cut`` is the score at the threshold ``at``."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    at: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        # Features far outside of what was seen say no more than the farthest seen.
        return np.clip((rows - self.centre) / self.scale, -8, 8) @ self.weights

    def chances(self, rows: np.ndarray) -> np.ndarray:
        x = self.scores(rows) - self.cut + math.log(self.at / (1 - self.at))
        return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def fit(good: np.ndarray, bad: np.ndarray, share_bad: float, at: float, pairs: int = PAIRS, penalty: float = PENALTY) -> Model:
    """A model from the features of good and of bad documents, which a share ``share_bad`` of the labelled ones is.

    ``pairs`` preferences go round both lists; the penalised logistic loss of their differences is
    minimised by Newton steps. Without one of the classes every document has the score
    of the other class: 0 or 1, or ``at`` if there is none.
    """
    width = len(NAMES)
    if not len(good) or not len(bad):
        away = 1e3 * (bool(len(good)) - bool(len(bad)))
        return Model(np.zeros(width), np.ones(width), np.zeros(width), -away, at)
    both = np.concatenate((good, bad))
    weight = np.concatenate((np.full(len(good), 0.5 / len(good)), np.full(len(bad), 0.5 / len(bad))))
    centre = weight @ both
    scale = np.maximum(np.sqrt(weight @ (both - centre) ** 2), 1e-6)
    unit = lambda x: np.clip((x - centre) / scale, -8, 8)
    n = min(pairs, len(good) * len(bad))
    i = np.arange(n)
    # Both indices run through their lists, one shifted at every full turn, so that no pair comes twice.
    turn = i // math.lcm(len(good), len(bad))
    difference = unit(good)[i % len(good)] - unit(bad)[(i + turn) % len(bad)]
    weights = np.zeros(width)
    for _ in range(50):
        wrong = 1 / (1 + np.exp(np.clip(difference @ weights, -700, 700)))
        gradient = -(wrong @ difference) / n + penalty * weights
        curve = (difference * (wrong * (1 - wrong))[:, None]).T @ difference / n + penalty * np.eye(width)
        step = np.linalg.solve(curve, gradient)
        step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        weights -= step
        if np.abs(step).max() < 1e-9:
            break
    model = Model(centre, scale, weights, 0.0, at)
    scores = model.scores(both)
    order = np.argsort(scores, kind="stable")
    mass = np.concatenate((np.full(len(good), (1 - share_bad) / len(good)), np.full(len(bad), share_bad / len(bad))))[order]
    place = int(np.searchsorted(np.cumsum(mass), share_bad - 1e-12)) + 1
    place = min(max(place, 1), len(order) - 1)
    cut = float(scores[order[place - 1 : place + 1]].mean())
    return Model(centre, scale, weights, cut, at)


def train(docs: DataFrame, labels: DataFrame, label_col: str, at: float, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """A model from the rows of ``labels`` (1 is good, 0 is bad, others are left out), at most ``sample`` of each, those of the least hash.

    Only these labels, a bounded number, are sent to the documents; the texts are not shuffled.
    Labels without a document and documents without a label are not learned from.
    """
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    counts = {r["_label"]: r["n"] for r in usable.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    place = (F.xxhash64("_id"), F.col("_id"))
    few = [usable.where(F.col("_label") == x).orderBy(*place).limit(sample) for x in (0, 1)]
    wanted = F.broadcast(few[0].unionAll(few[1]))  # 2 * sample rows of two numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in (part for whole in batches for part in slices(whole, "text")):
            rows = [features(t).tolist() for t in texts(x.column("text"))]
            yield pa.RecordBatch.from_arrays([x.column("_label"), pa.array(rows, pa.list_(pa.float64()))], names=["label", "x"])

    held = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(wanted, "_id").select("_label", "text")
    rows = held.mapInArrow(run, "label int, x array<double>").collect()  # ``sample`` rows of each class, more only where an id is repeated
    part = lambda k: np.array(sorted(r["x"] for r in rows if r["label"] == k)).reshape(-1, len(NAMES))
    share = counts.get(0, 0) / max(1, sum(counts.values()))
    return fit(_shuffled(part(1)), _shuffled(part(0)), share, at)


def _shuffled(rows: np.ndarray) -> np.ndarray:
    return rows[np.random.default_rng(0).permutation(len(rows))]


def score(docs: DataFrame, model: Model, text_col: str = "text", into: str = "quality") -> DataFrame:
    """``docs`` with a struct ``into``: ``score`` between 0 and 1, and ``predicted``, 1 from the model's threshold on.

    Null and empty texts have the features of a text without words and are scored by them. Each row
    stands for itself, an empty table stays empty, and an existing column ``into`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(into)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in (part for whole in batches for part in slices(whole, text_col)):
            rows = np.array([features(t) for t in texts(x.column(text_col))]).reshape(-1, len(NAMES))
            chances = shared.value.chances(rows)
            found = [pa.array(chances, pa.float64()), pa.array((chances >= shared.value.at).astype(np.int32), pa.int32())]
            struct = pa.StructArray.from_arrays(found, names=["score", "predicted"])
            yield pa.RecordBatch.from_arrays([*x.columns, struct], names=[*x.schema.names, into])

    kind = "struct<score: double, predicted: int>"
    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{into}` {kind}"]))
