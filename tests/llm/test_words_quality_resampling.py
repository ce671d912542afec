"""Spelling variants, quality and importance resampling against brute force, and on nulls, empties, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsprep.llm import quality, resample, spelling

DOCS = "doc_id bigint, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CLASH = ("word", "n", "hash", "row", "score", "weight", "rank", "_chunk", "_digit", "edit", "key", "_id", "label")


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    base = ["".join(rng.choice("abcéß") for _ in range(rng.randint(5, 9))) for _ in range(40)]

    def variant(word):
        i = rng.randrange(len(word))
        return rng.choice([word, word, word, word[:i] + word[i + 1 :], word[:i] + rng.choice("abé") + word[i + 1 :], word[:i] + "c" + word[i:]])

    out = [(i, " ".join(variant(rng.choice(base)) for _ in range(rng.randint(1, 90)))) for i in range(150)]
    out += [(200, None), (201, ""), (202, "12 !?"), (203, "One-TWO " * 30), (203, "One-TWO " * 30), (None, "Été été " * 12), (None, None)]
    out += [(204, " ".join(base) * 400), (205, "é" * 70_000), (206, "x" * 70_001)] + [(300 + i, "longword" * 12 + "y" * (i % 2)) for i in range(14)]
    out += [(400 + i, "q" * (80 + i % 3) + " aaaaaa aaaaab aaaaa") for i in range(18)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5).withColumns({c: F.lit("mine") for c in CLASH})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def variants(rows, noise, ratio=5):
    """All pairs of words, one by one."""
    count = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = ascii_lower(run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if noise and h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        a, b = sorted((a, b), key=len)
        i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
        return a[i + (len(a) == len(b)) :] == b[i + 1 :]

    neighbours = {w: [x for x in words if near(w, x)] for w in words}
    form = {}
    for w, around in neighbours.items():
        best = min(around, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(neighbours[w]), words.get(form[w])) for w, n in words.items()}


def found(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("noise, ratio", [(None, 5), (7, 2)])
def test_spelling(docs, rows, noise, ratio):
    wanted = variants(rows, noise, ratio)
    assert any(v[0] for v in wanted.values()) and any(len(w) > 64 for w in wanted)
    assert found(spelling.spelling_variants(docs, noise=noise, ratio=ratio)) == wanted


def test_spelling_by_many_filters(docs, rows, monkeypatch):
    """Several shards of a length and several broadcasts find the same."""
    monkeypatch.setattr(spelling, "SHARD_WORDS", 7)
    monkeypatch.setattr(spelling, "BROADCAST", 200)
    assert found(spelling.spelling_variants(docs, noise=7, ratio=2)) == variants(rows, 7, 2)


def test_spelling_counts_in_bounded_memory(docs, rows, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 5)
    got = {r["word"]: r["n"] for r in spelling.counted(docs, "doc_id", "text", None, 6).collect()}
    wanted = Counter(w for _, t in rows for w in map(ascii_lower, re.findall("[A-Za-zÀ-ÿ]+", t or "")) if len(w) >= 6)
    assert got == wanted


def test_spelling_of_nothing(empty):
    assert spelling.spelling_variants(empty, noise=199).collect() == []
    with pytest.raises(ValueError):
        spelling.spelling_variants(empty, ratio=1)


def test_a_chain_of_forms(spark):
    """Each word is a form of the one before; the ends meet after several steps."""
    names = ["aaaaaaa" + "b" * i for i in range(5)]
    rows = [(1, " ".join([w] * 5 * 2**i)) for i, w in enumerate(names)]
    got = found(spelling.spelling_variants(spark.createDataFrame(rows, DOCS), ratio=2))
    assert [got[w][0] for w in names] == [*names[1:], None] and {got[w][1] for w in names} == {names[-1]}


def test_edits_meet_once():
    """Every pair of words one edit apart is one edit of one of them, and its hash is the other's."""
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("aab") for _ in range(rng.randint(1, 7))) for _ in range(90)})
    alphabet = np.array([ord("a"), ord("b")], np.uint64)
    value = {}
    for at, codes in spelling.by_length(words):
        value |= dict(zip((words[i] for i in at), spelling.polynomial(codes).tolist()))
    by_hash = {h: w for w, h in value.items()}
    assert len(by_hash) == len(words)
    met = Counter()
    for at, codes in spelling.by_length(words):
        for place, word, edit, letter in spelling.edits(codes, alphabet):
            for i, (j, h) in enumerate(zip(word.tolist(), edit.tolist())):
                own = words[at[j]]
                made = own[:place] + ("" if letter is None else chr(int(letter[i]))) + own[place + 1 :]
                if made in value:
                    assert value[made] == h
                    met[frozenset((own, made))] += 1
    wanted = {frozenset((a, b)) for a in words for b in words if a != b and abs(len(a) - len(b)) < 2 and any(
        a[:i] + x + a[i + 1 :] == b for i in range(len(a)) for x in ("", "a", "b"))}
    assert set(met) == wanted and set(met.values()) == {1}


def test_filters_hold_what_they_are_given():
    rng = np.random.default_rng(1)
    held, other = (rng.integers(0, 2**63, 20_000).astype(np.uint64) for _ in range(2))
    words = spelling.build(held)
    assert len(spelling.probe(words, held)) == len(held)
    assert len(spelling.probe(words, other)) < 0.005 * len(other)
    assert spelling.build(held[:0]).shape == (1, 8) and len(spelling.probe(spelling.build(held[:0]), held)) == 0


def features(text):
    words = WORD.findall(ascii_lower(text))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def drawn(rows, target, least=20, share=(25, 100), buckets=10_000, seed=7):
    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    raw, aim = Counter(bucket(f) for _, t in rows for f in features(t)[1]), Counter(bucket(f) for t in target for f in features(t)[1])
    s_all, t_all = sum(raw.values()), sum(aim.values())
    gain = [math.floor(1000 * math.log((aim[i] + 1) * (s_all + buckets) / ((raw[i] + 1) * (t_all + buckets)))) for i in range(buckets)]
    out, able = [], []
    for i, (key, text) in enumerate(rows):
        words, all_ = features(text)
        weight = sum(gain[bucket(f)] for f in all_) // len(all_) if all_ else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([key, len(all_), weight, score, None])
        if len(words) >= least:
            able.append((-score, key is None, key or 0, i))
    for place, (*_, i) in enumerate(sorted(able)[: share[0] * len(able) // share[1]]):
        out[i][4] = place + 1
    return sorted(map(str, out))


def listed(df):
    return sorted(str(list(r)) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect())


@pytest.mark.parametrize("share", [(25, 100), (1, 1), (0, 1)])
def test_resampling(spark, docs, rows, share):
    target = [features(t)[0][0] + " une été" for _, t in rows[:20]] + [None, ""]
    aim = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id int, text string")
    assert listed(resample.resample(docs, aim, share=share)) == drawn(rows, target, share=share)


def test_resampling_in_small_chunks(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(resample, "CHUNK_BITS", 3)
    aim = spark.createDataFrame([("été",)], "text string")
    assert listed(resample.resample(docs, aim, least_words=1, share=(1, 2))) == drawn(rows, ["été"], least=1, share=(1, 2))


def test_resampling_of_nothing(spark, empty, docs, rows):
    aim = spark.createDataFrame([], "text string")
    assert resample.resample(empty, aim).collect() == []
    assert listed(resample.resample(docs, aim)) == drawn(rows, [])


def test_stretches_hold_every_feature_once(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(4000)).encode() + b"  A-b "
    whole = [x for _, b in resample.hashed(text, 3, 1 << 32) for x in b]
    monkeypatch.setattr(resample, "STRETCH", 50)
    parts = list(resample.hashed(text, 3, 1 << 32))
    assert len(parts) > 100 and Counter(whole) == Counter(x for _, b in parts for x in b)
    assert sum(n for n, _ in parts) == 4002


def test_radix_sort(spark, monkeypatch):
    """Against a plain sort: negative, extreme, null and equal keys, over many chunks."""
    monkeypatch.setattr(resample, "CHUNK_BITS", 4)
    rng = random.Random(2)
    ends = [None, 0, -1, 1, 2**63 - 1, -(2**63)]
    data = [(rng.choice([None, -3, 5, 5, 70_000, -(2**40)]), rng.choice([*ends, rng.randrange(-(2**62), 2**62)])) for _ in range(400)]
    df = spark.createDataFrame(data, "a bigint, b bigint").repartition(7).withColumn("row", F.monotonically_increasing_id())
    df = spark.createDataFrame(df.collect(), df.schema)
    order = lambda r: (r["a"] is None, r["a"] or 0, r["b"] is None, r["b"] or 0, r["row"])
    wanted = [(r["a"], r["b"]) for r in sorted(df.collect(), key=order)]
    got = resample.radix_sorted(df, [F.col("a"), F.col("b")]).collect()
    assert sorted(r["row"] for r in got) == list(range(400))
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["row"])] == wanted
    same = spark.range(50).select(F.lit(1).cast("bigint").alias("a"), F.col("id").alias("row"))
    assert sorted(r["row"] for r in resample.radix_sorted(same, [F.col("a")]).collect()) == list(range(50))
    assert resample.radix_sorted(same.limit(0), [F.col("a")]).collect() == []


def plain_text(rng, n=60):
    return ". ".join(" ".join(rng.choice("the of and river house walks slowly green light under stone".split()) + str(rng.randrange(40)) * 0 +
                              rng.choice(["", "s", "ed", "ing", "ly"]) for _ in range(9)).capitalize() for _ in range(n // 9 + 1)) + "."


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(4)
    bad = [lambda t: t.replace(" ", "!! ").upper(), lambda t: " ".join([t.split()[0]] * 80), lambda t: t.replace(" ", "### "), lambda t: t.replace(" ", " | ")]
    rows, labels = [], []
    for i in range(240):
        text = plain_text(rng, rng.randint(20, 120))
        rows.append((i, rng.choice(bad)(text) if i % 5 == 0 else text))
        labels.append((i, int(i % 5 != 0)))
    extra = [(900, None), (901, ""), (902, " \n"), (903, plain_text(rng, 200) * 400), (0, rows[0][1]), (None, rows[1][1])]
    return spark.createDataFrame(rows + extra, DOCS).repartition(3).withColumns({c: F.lit("mine") for c in (*CLASH, "quality", "_label", "x")}), labels, len(rows) + len(extra)


LABELS = "doc_id bigint, quality int"


def test_quality(spark, judged):
    docs, labels, n = judged
    learned = spark.createDataFrame([x for x in labels if x[0] % 3] + [(None, 1), (1, None), (2, 7), (5000, 0)], LABELS)
    model = quality.train(docs, learned, "quality", at=0.3)
    got = quality.score(docs, model).collect()
    assert len(got) == n and got[0]["word"] == "mine"
    right = [r["quality"]["predicted"] == dict(labels)[r["doc_id"]] for r in got if r["doc_id"] is not None and r["doc_id"] < 900 and r["doc_id"] % 3 == 0]
    assert sum(right) >= 0.97 * len(right)
    assert all(0 <= r["quality"]["score"] <= 1 and r["quality"]["predicted"] == (r["quality"]["score"] >= 0.3) for r in got)
    again = {r["doc_id"]: r["quality"]["score"] for r in quality.score(docs.repartition(7), quality.train(docs.repartition(2), learned, "quality", at=0.3)).collect()}
    assert all(abs(again[r["doc_id"]] - r["quality"]["score"]) < 1e-9 for r in got)


def test_quality_without_a_class(spark, judged, empty):
    docs, labels, n = judged
    for rows, wanted in (([], 0.3), ([x for x in labels if x[1]], 1.0), ([x for x in labels if not x[1]], 0.0)):
        model = quality.train(docs, spark.createDataFrame(rows, LABELS), "quality", at=0.3)
        assert {round(r["quality"]["score"], 9) for r in quality.score(docs, model).collect()} == {wanted}
    assert quality.score(empty, model).collect() == []


def test_the_preferences_are_fitted():
    """The gradient of the penalised loss over the same pairs vanishes, and the cut leaves the wanted share below it."""
    rng = np.random.default_rng(5)
    good, bad = rng.normal(0.5, 1, (70, len(quality.NAMES))), rng.normal(0, 1, (30, len(quality.NAMES)))
    model = quality.fit(good, bad, share_bad=0.3, at=0.3, pairs=2100, penalty=0.01)
    pairs = [(a, b) for a in model.scores(good) for b in model.scores(bad)]
    unit = lambda x: np.clip((x - model.centre) / model.scale, -8, 8)
    gradient = 0.01 * model.weights
    for g in good:
        for b in bad:
            d = unit(g[None])[0] - unit(b[None])[0]
            gradient -= d / (1 + math.exp(d @ model.weights)) / len(pairs)
    assert np.abs(gradient).max() < 1e-8
    below = np.concatenate((model.scores(good), model.scores(bad))) < model.cut
    assert abs(below.sum() - 30) <= 1
    chances = model.chances(np.concatenate((good, bad)))
    assert ((chances >= 0.3) == ~below).all()


def test_features_of_long_texts(monkeypatch):
    rng = random.Random(6)
    text = plain_text(rng, 3000).encode()
    whole = quality.features(text)
    monkeypatch.setattr(quality, "STRETCH", 2000)
    assert b"".join(quality.stretches(text)) == text and len(list(quality.stretches(text))) > 5
    parts = quality.features(text)
    assert abs(whole[0] - parts[0]) < 1e-9 and np.abs(whole[1:7] - parts[1:7]).max() < 0.02
