"""Spelling variants: words one edit apart, found by probing Bloom filters with generated edits.

The vocabulary is counted once. Its words are hashed by a polynomial in their letters, so that the
hash of every deletion and replacement follows from the word's own without building the text, and
put into Bloom filters of 512-bit blocks, sharded by the words' length. The filters are broadcast,
a bounded number of bytes at a time; tasks generate the edits of their words and probe them. Only
edits that hit go through a shuffle, to an exact join with the vocabulary that removes what the
filters let through by chance. An insertion is a deletion seen from the longer word.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, batch, slices, written

#: A run of letters; its form with A-Z in lower case is what counts.
RUN = "[A-Za-zÀ-ÿ]+"
#: Words and bits per word of a filter, bytes of filters in one broadcast, and distinct words a task counts before it sends them on.
SHARD_WORDS, BITS, BROADCAST, HELD = 1 << 20, 16, 1 << 26, 1 << 18
#: Lengths from this one on share their shards.
LONGEST = 64
#: Odd multiplier of the polynomial, and one odd multiplier for each word of a block.
BASE = 0x9E3779B97F4A7C15
LANES = np.random.default_rng(20240101).integers(0, 1 << 64, 8, np.uint64) | np.uint64(1)


def counted(docs: DataFrame, id_col: str, text_col: str, noise: int | None, least_length: int) -> DataFrame:
    """``word, n`` of all words of at least ``least_length`` letters; tasks add up before the shuffle."""
    run = re.compile(RUN)

    def words(key: object, text: str) -> Iterator[tuple[str, int]]:
        lowered = text.encode().translate(LOWER).decode()
        start = crc32(f"{'' if key is None else key}:".encode())
        for word, n in Counter(run.findall(lowered)).items():
            if len(word) < least_length:
                continue
            if noise:
                h = crc32(word.encode(), start)
                if h % noise == 0:
                    word = word[: h % len(word)] + word[h % len(word) + 1 :]
                    if len(word) < least_length:
                        continue
            yield word, n

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
        for x in (part for whole in batches for part in slices(whole, "text")):
            for key, text in zip(x.column("key").to_pylist(), x.column("text").to_pylist(), strict=True):
                for word, n in words(key, text or ""):
                    held[word] += n
            if len(held) > HELD:
                yield batch(schema, [list(held), list(held.values())])
                held.clear()
        yield batch(schema, [list(held), list(held.values())])

    narrow = docs.select(F.col(id_col).cast("string").alias("key"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def polynomial(codes: np.ndarray) -> np.ndarray:
    """The hash of words of one length, given as rows of letters."""
    value = np.zeros(len(codes), np.uint64)
    for i in range(codes.shape[1]):
        value = value * np.uint64(BASE) + codes[:, i]
    return value


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The positions of words of one length and their letters as rows, in bounded blocks."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        step = max(1, (1 << 18) // max(1, length))
        for i in range(0, len(at), step):
            some = at[i : i + step]
            joined = "".join(words[j] for j in some)
            yield some, np.frombuffer(joined.encode("utf-32-le"), np.uint32).reshape(len(some), length).astype(np.uint64)


def edits(codes: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray | None]]:
    """``place, word, hash, letter`` of the deletions (no letter), then of the replacements by a greater letter.

    Of equal letters in a row the last is deleted. So two words one edit apart meet in exactly one edit.
    """
    n, length = codes.shape
    base, whole = np.uint64(BASE), polynomial(codes)
    powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(length, base))), dtype=np.uint64)
    head = np.zeros(n, np.uint64)
    for i in range(length):
        power = powers[length - 1 - i]
        rest = whole - (head * base + codes[:, i]) * power  # the hash of what follows
        last = np.flatnonzero(codes[:, i] != codes[:, i + 1]) if i + 1 < length else np.arange(n)
        yield i, last, head[last] * power + rest[last], None
        word, letter = np.nonzero(alphabet[None, :] > codes[:, i : i + 1])
        yield i, word, whole[word] + (alphabet[letter] - codes[word, i]) * power, alphabet[letter]
        head = head * base + codes[:, i]


def _mixed(hashes: np.ndarray) -> np.ndarray:
    x = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The shard of a hash among those of its length."""
    return (_mixed(hashes ^ np.uint64(0x5DEECE66D)) >> np.uint64(33)).astype(np.int64) % parts


def _places(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    x = _mixed(hashes)
    return (x >> np.uint64(32)).astype(np.int64) * blocks >> 32, x


def build(hashes: np.ndarray) -> np.ndarray:
    """A blocked Bloom filter: each hash sets one bit in each of the eight words of one block."""
    blocks = max(1, len(hashes) * BITS // 512)
    words = np.zeros((blocks, 8), np.uint64)
    block, x = _places(hashes, blocks)
    for lane in range(8):
        np.bitwise_or.at(words[:, lane], block, np.uint64(1) << (x * LANES[lane] >> np.uint64(58)))
    return words


def probe(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The positions of the hashes that the filter may hold; it never misses one that it holds."""
    block, x = _places(hashes, len(words))
    left = np.arange(len(hashes))
    for lane in range(8):
        bit = (words[block[left], lane] >> (x[left] * LANES[lane] >> np.uint64(58))) & np.uint64(1)
        left = left[bit == 1]
    return left


def hashed(vocabulary: DataFrame) -> DataFrame:
    """``word, n, hash, length`` of ``word, n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            words = x.column("word").to_pylist()
            value = np.zeros(len(words), np.uint64)
            for at, codes in by_length(words):
                value[at] = polynomial(codes)
            length = pa.array([len(w) for w in words], pa.int32())
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(value.view(np.int64)), length], names=["word", "n", "hash", "length"])

    return vocabulary.mapInArrow(run, "word string, n bigint, hash bigint, length int")


def filters(vocabulary: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """One row per shard, ``size, part, bits``, as a table, and the number of shards of each size; a size is a length up to ``LONGEST``."""
    size = F.least("length", F.lit(LONGEST)).alias("size")
    counts = vocabulary.groupBy(size).agg(F.count("*").alias("n")).collect()  # one row per size
    parts = {r["size"]: -(-r["n"] // SHARD_WORDS) for r in counts}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            sizes, hashes = x.column("size").to_numpy(), x.column("hash").to_numpy().view(np.uint64)
            part = part_of(hashes, np.array([parts[s] for s in sizes.tolist()], np.int64)) if len(sizes) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(part.astype(np.int32))], names=["size", "hash", "part"])

    def shard(rows: pa.Table) -> pa.Table:
        words = build(rows.column("hash").to_numpy().view(np.uint64))
        return pa.table({"size": rows.column("size")[:1], "part": rows.column("part")[:1], "bits": pa.array([words.tobytes()], pa.binary())})

    dealt = vocabulary.select(size, "hash").mapInArrow(deal, "size int, hash bigint, part int")
    return written(dealt.groupBy("size", "part").applyInArrow(shard, "size int, part int, bits binary"), "filters"), parts


def rounds(table: DataFrame) -> Iterator[dict[tuple[int, int], bytes]]:
    """The filters in broadcasts of about ``BROADCAST`` bytes, in the order of their sizes; a single filter holds ``SHARD_WORDS`` words or little more."""
    held, size = {}, 0
    for row in table.orderBy("size", "part").toLocalIterator():
        held[row["size"], row["part"]] = bytes(row["bits"])
        size += len(row["bits"])
        if size >= BROADCAST:
            yield held
            held, size = {}, 0
    if held:
        yield held


HITS = pa.schema([("hash", pa.int64()), ("place", pa.int32()), ("letter", pa.string()), ("edit", pa.int64())])


def hits(vocabulary: DataFrame, shared, parts: dict[int, int], alphabet: list[str]) -> DataFrame:
    """``hash, place, letter, edit`` of every edit that one of the broadcast filters may hold."""
    letters = np.array(sorted(map(ord, alphabet)), np.uint64)
    names = np.array([chr(int(c)) for c in letters], object)
    here: dict[int, list[int]] = {}
    for size, part in shared.value:
        here.setdefault(size, []).append(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = {k: np.frombuffer(b, np.uint64).reshape(-1, 8) for k, b in shared.value.items()}
        for x in batches:
            own = x.column("hash").to_numpy()
            for at, codes in by_length(x.column("word").to_pylist()):
                length = codes.shape[1]
                out: list[list[np.ndarray]] = [[], [], [], []]
                for place, word, edit, letter in edits(codes, letters):
                    size = min(length - (letter is None), LONGEST)
                    if size not in here or not len(word):
                        continue
                    part = part_of(edit, parts[size]) if parts[size] > 1 else None
                    for p in here[size]:
                        mine = np.flatnonzero(part == p) if part is not None else slice(None)
                        left = probe(bits[size, p], edit[mine])
                        some = left if part is None else mine[left]
                        text = np.full(len(some), None, object) if letter is None else names[np.searchsorted(letters, letter[some])]
                        for column, value in zip(out, (own[at[word[some]]], np.full(len(some), place, np.int32), text, edit[some].view(np.int64)), strict=True):
                            column.append(value)
                if out[0]:
                    yield batch(HITS, [np.concatenate(c) for c in out])

    reach = sorted(here.keys() | {size + 1 for size in here})  # a deletion falls in the size below
    able = vocabulary.where(F.least("length", F.lit(LONGEST)).isin(reach))
    return able.select("word", "hash").mapInArrow(run, "hash bigint, place int, letter string, edit bigint")


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """``a, a_n, b, b_n`` of all words that differ by one edit, each pair once, as a table.

    The positives of the filters meet the vocabulary by the edit's hash and the length it stands
    for; the edit is then made in the text and compared, so no chance agreement stays and no pair is lost.
    """
    spark = vocabulary.sparkSession
    alphabet = [r[0] for r in vocabulary.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect()]  # letters of RUN
    table, parts = filters(vocabulary)
    found = None
    for held in rounds(table):
        some = written(hits(vocabulary, spark.sparkContext.broadcast(held), parts, alphabet), "hits")
        found = some if found is None else found.unionAll(some)
    if found is None:
        return vocabulary.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("word").alias("b"), F.col("n").alias("b_n")).limit(0)
    right = vocabulary.select(F.col("hash").alias("edit"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    left = vocabulary.select("hash", F.col("word").alias("a"), F.col("n").alias("a_n"))
    before = F.col("a").substr(F.lit(1), F.col("place"))
    after = F.col("a").substr(F.col("place") + 2, F.length("a"))
    made = F.concat(before, F.coalesce("letter", F.lit("")), after)
    pairs = found.join(right, "edit").join(left, "hash").where(made == F.col("b"))
    return written(pairs.select("a", "a_n", "b", "b_n"), "near")


def roots(links: DataFrame, steps: int) -> DataFrame:
    """``word, root`` of ``word, form``: the end of each chain, by doubling what a step spans; chains have at most ``2 ** steps`` links."""
    found = links.select("word", F.col("form").alias("root"))
    for _ in range(steps):
        ahead = found.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        found = written(found.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "roots")
    return found


def spelling_variants(
    docs: DataFrame, least_length: int = 6, least_count: int = 5, ratio: int = 5, noise: int | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the table.

    Words are runs of letters, A-Z in lower case, of at least ``least_length`` letters and
    ``least_count`` occurrences. Two are near if one inserted, deleted or replaced letter makes one
    of the other. The form is the most frequent near word, ties to the first in code-point order, if
    it is at least ``ratio`` times as frequent, ``ratio`` being 2 or more; the root is the last of the chain of forms, or the
    word itself. With ``noise``, a word whose checksum with the document's id it divides loses a
    letter first, in that document. Null and empty texts hold no words, a null id is the empty id;
    repeated rows count as often as they stand. An empty table gives an empty result. Other columns are ignored.
    """
    if ratio < 2:
        raise ValueError("ratio is at least 2, so that chains of forms end")
    often = counted(docs, id_col, text_col, noise, least_length).where(F.col("n") >= least_count)
    vocabulary = written(hashed(often), "vocabulary")
    pairs = near_pairs(vocabulary)
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    best = F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("form")))
    near = both.groupBy(F.col("a").alias("word")).agg(F.first("a_n").alias("_n"), F.count("*").alias("n_near"), best.alias("_best"))
    enough = -F.col("_best.less") >= F.col("_n") * ratio
    near = written(near.select(
        "word", "n_near", F.when(enough, F.col("_best.form")).alias("form"), F.when(enough, -F.col("_best.less")).alias("form_n")
    ), "forms")
    most = vocabulary.agg(F.max("n")).first()[0] or 1
    # Each link multiplies the count by ``ratio`` at least.
    links = max(1, math.ceil(math.log(max(most / least_count, 1), ratio)) + 1)
    ends = roots(near.where(F.col("form").isNotNull()).select("word", "form"), math.ceil(math.log2(links)))
    return (
        vocabulary.select("word", "n").join(near, "word", "left").join(ends, "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")
    )
