"""Each operator on small tables against brute force, and on nulls, empties, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsprep.llm import decontaminate, extract, langid, licenses, mixing, neardup, sharding, suffixes, surrogates, topk

DOCS = "doc_id bigint, text string, lang string, source string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def rows():
    """Prose, copies, near copies, nulls, empties, a very long text, repeated rows and ids."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgéß") for _ in range(rng.randint(1, 7))) for _ in range(900)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = text(150)
    out = [(i, text(rng.randint(1, 120)), "en", f"s{i % 4}") for i in range(60)]
    for i in range(60, 90):  # near copies of one text, each with a few words changed
        words = base.split()
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = f"edit{i}x{rng.randint(0, 99)}"
        out.append((i, " ".join(words), "en", "s0"))
    out += [(i, base.upper(), "en", None) for i in range(90, 100)]
    out += [(100, None, None, None), (101, "", "en", "s1"), (102, " \n\t", "en", "s1"), (103, text(9000) + base, "en", "s2")]
    out += [(104, "!?", None, "s1"), (105, "one", "en", "s1"), (106, "One", "en", "s1"), (107, "two words", "en", "s1")]
    out += [(108, "ab " * 300, "en", "s3"), (108, "ab " * 300, "en", "s3"), (None, base, "en", "s3"), (None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    """The rows with columns whose names the operators might use themselves."""
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    return df.withColumns({c: F.lit("mine") for c in ("size", "shard", "place", "host", "found", "row", "spans", "n", "bands", "language", "entities", "licenses")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_mix(docs, rows, empty):
    got = mixing.mix(docs).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += count(t)
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, targets, pool = 1.5 * sum(sizes.values()), {}, set(names)
    while pool:
        level = left / sum(weight[s] for s in pool)
        over = {s for s in pool if weight[s] * level > 2 * sizes[s]}
        if not over:
            targets |= {s: weight[s] * level for s in pool}
            break
        for s in over:
            targets[s] = 2.0 * sizes[s]
            left -= 2 * sizes[s]
        pool -= over
    by_id = defaultdict(list)
    for i, t, _, s in rows:
        by_id[i].append((count(t), sizes[s], targets[s]))
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert any(r["size"] == a and r["source_size"] == b and abs(r["target"] - c) < 1e-6 for a, b, c in by_id[r["doc_id"]])
        assert r["taken"] <= 2 * r["size"]
        taken[r["source_size"], round(r["target"], 6)] += r["taken"]
    largest = max(count(t) for _, t, _, _ in rows)
    for (_, target), words in taken.items():
        assert abs(words - target) <= largest
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(empty).count() == 0


def test_mixed_repeats_rows(docs):
    plan = Counter()
    for r in mixing.mix(docs.where("doc_id < 100")).collect():
        plan[r["doc_id"]] = r["taken"] // r["size"]
    df = mixing.mixed(docs.where("doc_id < 100"))
    assert df.columns == docs.columns
    assert Counter(r["doc_id"] for r in df.collect()) == +plan


def test_targets_nested(docs):
    """A larger share takes every document that a smaller one takes."""
    sized = mixing.with_place(docs.where("doc_id < 60"))
    few, many = (mixing.mix_plan(sized, share=s, most=1.0).select("source", "copies", F.coalesce("below", F.lit("")).alias("below")).collect() for s in (0.3, 0.5))
    for a, b in zip(sorted(few), sorted(many), strict=True):
        assert (a["copies"], a["below"]) <= (b["copies"], b["below"])


def test_shard(docs, rows, empty):
    got = sharding.shard(docs, 4).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode())))
    sizes = [len((r[1] or "").encode()) + 1 for r in order]
    before, seen, wanted = 0, Counter(), []
    for r, size in zip(order, sizes, strict=True):
        shard = min(3, (2 * before + size) * 4 // (2 * sum(sizes)))
        wanted.append((r[0], size, zlib.crc32((r[1] or "").encode()), "bytes", shard, seen[shard], None))
        seen[shard] += 1
        before += size
    assert sorted(map(str, wanted)) == sorted(str(tuple(r)) for r in got)
    assert sharding.shard(empty).count() == 0


def test_decontaminate(spark, docs, rows, empty):
    texts = [(r[1] or "") for r in rows]
    long = next(t for t in texts if len(t.split()) > 60).split()
    items = [(1, " ".join(long[5:18]).upper()), (2, " ".join(long[12:40])), (3, "Two, words"), (4, None), (5, "?!"), (2, " ".join(long[12:40])), (None, "one")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.decontaminate(docs, bench).collect()
    patterns = defaultdict(set)
    for i, t in items:
        w = WORD.findall(ascii_lower(t))
        for j in range(max(1, len(w) - 9) if w else 0):
            patterns[tuple(w[j : j + 10])].add("" if i is None else str(i))
    wanted = []
    for t in texts:
        w = WORD.findall(ascii_lower(t))
        hit, found = set(), set()
        for p, owners in patterns.items():
            for j in range(len(w) - len(p) + 1):
                if tuple(w[j : j + len(p)]) == p:
                    hit |= set(range(j, j + len(p)))
                    found |= owners
        wanted.append((len(w), len(hit), sorted(found)))
    assert sorted(map(str, wanted)) == sorted(str((r["found"]["n_words"], r["found"]["n_hit"], r["found"]["items"])) for r in got)
    assert any(h for _, h, _ in wanted) and "found" in docs.columns
    for r in got:  # offsets are those of the original text
        covered = [WORD.findall(ascii_lower(r["text"][a:b])) for a, b in r["found"]["spans"]]
        assert sum(map(len, covered)) == r["found"]["n_hit"]
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert {r["found"]["n_hit"] for r in decontaminate.decontaminate(docs, bench.limit(0)).collect()} == {0}


def test_decontaminate_several_automata(spark, docs, monkeypatch):
    bench = docs.where("doc_id IN (3, 7, 11, 60)").select(F.col("doc_id").alias("item_id"), "text")
    once = decontaminate.decontaminate(docs, bench).select("doc_id", "found.n_hit", "found.items")
    wanted = sorted(map(str, once.collect()))
    monkeypatch.setattr(decontaminate.blocks, "__defaults__", (50,))
    many = decontaminate.decontaminate(docs, bench).select("doc_id", "found.n_hit", "found.items")
    assert sorted(map(str, many.collect())) == wanted


def test_automata_follow_the_content():
    """A later block is scanned with its own automaton, also where it stands at the address of an earlier one."""
    class Block:
        value: dict = {}

    block = Block()
    for pattern, owner in ((" a b ", "1"), (" c d ", "2")):
        block.value.clear()  # the same dict, so the same id
        block.value[pattern] = [owner]
        (automaton,) = decontaminate._automata([(pattern, block)])
        assert decontaminate.scan(b"a b x c d", [automaton])[2] == {owner}
        assert list(decontaminate._BUILT) == [pattern]


def test_top_k(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.normal(size=8).round(2)]) for i in range(300)]
    vectors += [(i, vectors[7][1]) for i in range(300, 420)]  # ties
    vectors += [(500, None), (501, [1.0, None]), (502, [float("nan")]), (503, [float("inf")]), (550, []), (600, [1.0]), (650, [0.0] * 8), (None, [1.0])]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").withColumn("score", F.lit(1)).repartition(4)
    got = topk.top_k(df, df.where("vec_id % 50 = 0")).collect()
    as32 = lambda v: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int).tolist()
    good = {i: as32(v) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    wanted = []
    for q in (i for i in good if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q)[:5]
        wanted += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(wanted)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_near_duplicates(docs, rows, empty):
    sets = {}
    for i, t, _, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(t))
        s = {tuple(w[j : j + 3]) for j in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()
        sets.setdefault(i, []).append(s)
    ids = [i for i in sets if i is not None]
    link = lambda a, b: any(x and y and 100 * len(x & y) >= 85 * len(x | y) for x in sets[a] for y in sets[b])
    name = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if name[b] < name[a] and link(a, b):
                    name[a], changed = name[b], True
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == name[r["doc_id"]], r
            assert r["kept"] == (r["doc_id"] == r["component_id"])
            assert r["n_shingles"] in {len(s) for s in sets[r["doc_id"]]}
    assert len(set(name.values())) < len(ids) - 20
    assert neardup.near_duplicates(empty).count() == 0
    left = neardup.without_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.where("doc_id IS NOT NULL").collect()) == sorted(set(name.values()))


def test_blocks_find_every_link():
    rng = random.Random(2)
    sets = [np.unique(np.array([rng.randrange(60) for _ in range(rng.randint(1, 40))], np.int64)) for _ in range(80)]
    sets += sets[:9]
    parent = list(range(len(sets)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a, b in neardup.linked(sets):
        assert 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))
        parent[find(a)] = find(b)
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b])):
                assert find(a) == find(b)


def test_registers_estimate_similarity():
    rng = np.random.default_rng(4)
    for size in (1, 7, 100, 5000):
        every = rng.integers(0, 2**63, size * 2, dtype=np.uint64)
        pairs = [(every[:size], every[size - int(size * 0.85) : 2 * size - int(size * 0.85)])]
        a, b = neardup.registers([np.unique(x) for x in pairs[0]])
        true = len(np.intersect1d(*pairs[0])) / len(np.union1d(*pairs[0]))
        assert abs((a == b).mean() - true) < 0.2


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200 + i) for i in range(40)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in neardup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(1, 51)) and all(got[200 + i] == 100 for i in range(40))


def removed(texts, length=200):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def test_remove_repeats(docs, rows, empty):
    texts = [(r[1] or "").encode() for r in rows]
    got = suffixes.remove_repeats(docs).select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(removed(texts))
    assert suffixes.remove_repeats(empty).count() == 0


def test_large_groups_are_split(docs, rows, monkeypatch):
    monkeypatch.setattr(suffixes, "CONTEXTS", 3)
    texts = [(r[1] or "").encode() for r in rows]
    got = suffixes.remove_repeats(docs).select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(removed(texts))


def test_two_stage_order():
    rng = random.Random(3)
    for t in range(120):
        letters = rng.choice([b"ab", b"abc\x00", bytes(range(256))])
        x = bytes(rng.choice(letters) for _ in range(rng.randint(1, 300)))
        x = x[:30] * rng.randint(1, 8) if t % 3 == 0 else x
        order = suffixes.two_stage(np.frombuffer(x, np.uint8), 24)
        assert sorted(order.tolist()) == list(range(len(x)))
        strings = [x[i : i + 24] for i in order if len(x) - i >= 24]
        assert strings == sorted(strings)


def test_language(spark, docs, rows, empty):
    data = [(i, ("the cat and the dog in the house " if i % 2 else "der hund und die katze im haus ") * 3, "en" if i % 2 else "de", "x") for i in range(60)]
    model = langid.train(spark.createDataFrame(data, DOCS))
    assert model[0] == ["de", "en"]
    asked = spark.createDataFrame([(1, "The house and THE cat", None, None), (2, "die Katze und der Hund", None, None), (3, None, None, None), (4, "12 !?", None, None), (5, "a\0b the", None, None)], DOCS)
    got = {r["doc_id"]: r["language"] for r in langid.predict(asked, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4)] == ["en", "de", "und", "und"]
    assert all(0 <= x["score"] <= 1 for x in got.values())
    assert len(langid.predict(docs, model).collect()) == len(rows)
    untrained = langid.train(empty)
    assert {r["language"]["lang_pred"] for r in langid.predict(asked, untrained).collect()} == {"und"}


def test_linear_scores_are_those_of_the_bundle(spark):
    """Adding up table entries equals bundling the n-gram vectors of the text."""
    import pyarrow as pa

    codes, owner, n = langid.grams(pa.array(["Größe, the end", "", None, "a"]))
    assert n.tolist() == [11, 0, 0, 1] and set(owner.tolist()) <= {0, 3}
    prototype = np.random.default_rng(0).normal(size=langid.DIMENSIONS)
    bundle = langid.bind(codes[owner == 0]).astype(float).sum(axis=0)
    assert np.isclose(bundle @ prototype, (langid.bind(codes[owner == 0]).astype(float) @ prototype).sum())


def test_licenses(spark, docs, rows, empty):
    template = dict(licenses.TEMPLATES)["gpl-text"]
    data = [(1, f"Intro. {template.upper()} end", "", ""), (2, "MIT License, the MIT  license", "", ""), (3, "mit licenses", "", ""), (4, None, "", ""),
            (5, " ".join(template.split()[:20]), "", ""), (6, "x General-Public License y Apache License" * 2, "", "")]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(spark.createDataFrame(data, DOCS)).collect()}
    for i, text, _, _ in data:
        words = WORD.findall(ascii_lower(text))
        places = [(j, label) for p, label in licenses.PHRASES for j in range(len(words)) if words[j : j + len(p.split())] == p.split()]
        assert got[i]["n_words"] == len(words) and got[i]["n_base"] == len(places)
        assert got[i]["first_word"] == min((j for j, _ in places), default=None) and got[i]["last_word"] == max((j for j, _ in places), default=None)
        assert got[i]["base_labels"] == ",".join(sorted({x for _, x in places}))
    assert "gpl-text" in got[1]["labels"] and got[1]["spans"][0]["start"] == 1
    assert "gpl-text" not in got[5]["labels"] and 0 <= got[5]["score"] < 1
    assert licenses.scan_licenses(docs).count() == len(rows) and licenses.scan_licenses(empty).count() == 0


def test_surrogates(spark, docs, rows, empty):
    text = "Mail anna.b@mail1.example.com or +1 (438) 555-7372, card 4111111111111111, host 89.119.26.177, Mrs. Anna Keller; password=c1f6c02f845bf3 anna.b@mail1.example.com"
    new, found = surrogates.replace(text, b"k")
    kinds = Counter(e[0] for e in found)
    assert kinds == {"email": 2, "phone": 1, "card": 1, "ip": 1, "person": 1, "secret": 1}
    assert all(old not in new for _, old, _, _ in found)
    assert len({e[2] for e in found if e[0] == "email"}) == 1 and len(new) >= len(text) - 9
    card = next(e[2] for e in found if e[0] == "card")
    assert surrogates._luhn(card) == 0 and len(card) == 16
    assert surrogates.replace(text, b"k")[0] == new != surrogates.replace(text, b"other")[0]
    assert surrogates.replace("nothing here 12", b"k") == ("nothing here 12", [])
    numbers = {f"{a:03d}-{b:02d}-1234" for a in range(60) for b in range(20)}
    assert len({surrogates.surrogate("ssn", x, b"k") for x in numbers}) == len(numbers)
    df = surrogates.with_surrogates(docs, b"k")
    assert Counter(r["text"] for r in df.collect()) == Counter(r[1] for r in rows)
    assert surrogates.with_surrogates(empty, b"k").count() == 0
    data = spark.createDataFrame([(i, f"u{i}@a.example.com 10.0.{i // 250}.{i % 250}", "", "") for i in range(500)], DOCS)
    assert surrogates.collisions(surrogates.with_surrogates(data, b"k")).count() == 0


def test_surrogates_of_padded_addresses():
    new, found = surrogates.replace("hosts 10.05.20.01 and 10.5.20.1, v00.09.08.07 on 01.02.03.04 or ٣.٤.٥.٦", b"k")
    assert [e[1] for e in found if e[0] == "ip"] == ["10.05.20.01", "10.5.20.1", "01.02.03.04", "٣.٤.٥.٦"]
    for _, old, surrogate, _ in found[:3]:
        assert surrogate != old
        for a, b in zip(old.split("."), surrogate.split("."), strict=True):
            assert int(b) < 256 and (len(b) > 1 and b[0] == "0") == (len(a) > 1 and a[0] == "0")
    every = [f"1.0{a}.0{b}.{c}" for a in range(10) for b in range(10) for c in range(0, 256, 25)] + [f"1.{a}.{b}.5" for a in range(10) for b in range(10)]
    assert len({surrogates.surrogate("ip", x, b"k") for x in every}) == len(every)


def test_surrogates_of_long_secrets():
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-."
    for n in (6, 200, 201, 300, 5000):
        value = "".join(rng.choice(letters) for _ in range(n - 1)) + "Q"
        new, found = surrogates.replace(f"token = {value} end", b"k")
        assert [(e[0], e[1], e[3]) for e in found] == [("secret", value, 8)]
        assert new == f"token = {found[0][2]} end" and len(found[0][2]) == n
        assert all(value[i : i + 100] not in new for i in range(0, n - 5, 50))
    other = f"{value[:-1]}R"  # differs in the last character only
    assert surrogates.surrogate("secret", other, b"k") != surrogates.surrogate("secret", value, b"k")
    assert surrogates.surrogate("secret", "g" + "0" * 999, b"k") != surrogates.surrogate("secret", "g" + "0" * 998 + "1", b"k")


def test_no_surrogate_equals_its_entity():
    names = [f"{a}{b}{c}" for a in "LBSÑÇŁ" for b in ("", "a", "e", "é", "š") for c in "ian"] + ["محمد", "أحمد", "דוד", "שרה", "김철수", "王小明", "Ωμέγα", "Юрий", "ひろし", "Øyvind"]
    for key in (b"k", b"l", b"m"):
        new = [surrogates.surrogate("person", x, key) for x in names]
        assert all(a != b and len(a) == len(b) for a, b in zip(names, new, strict=True)) and len(set(new)) == len(set(names))
    title, found = surrogates.replace("Mr. محمد علي, Dr. 김철수, Frau שרה", b"k")
    assert len(found) == 3 and all(e[1] not in title for e in found)
    for size in (2, 3, 5, 21, 105, 1000):  # one bijection without a fixed point, also of a part
        for good in (lambda n: True, lambda n: n % 3 != 2 or size < 5):
            some = [n for n in range(size) if good(n)]
            image = [surrogates._permute(n, size, b"k", good) for n in some]
            assert sorted(image) == some and all(a != b for a, b in zip(some, image, strict=True))
    cards = {f"4{i:04d}00000000000"[:-1] + str(i % 10) for i in range(3000)} | {f"40000000000{i:05d}" for i in range(3000)}
    for kind, values in (("card", cards), ("secret", {f"{a}{b}0000" for a in "abcdefghij" for b in "abcdefghij"}), ("ssn", {"123-45-6789", "٣٢١-٤٥-٦٧٨٩"})):
        new = {x: surrogates.surrogate(kind, x, b"k") for x in values}
        assert all(a != b for a, b in new.items()) and len(set(new.values())) == len(values)
        assert kind != "secret" or all(bool(re.fullmatch("[0-9a-f]+", a)) == bool(re.fullmatch("[0-9a-f]+", b)) for a, b in new.items())
    assert surrogates.replace("password = ........", b"k")[1] == []


def page(i, body, extra=""):
    return (i, f"https://h.example/{i}", f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><ul><li>Home</li></ul></nav><div class='cookie-notice'>We use &amp; like</div>{body}<div class=\"comments\"><p>nice {i}</p></div><footer>&copy; x</footer>{extra}</body></html>")


def test_extract(spark):
    data = [page(i, f"<article><h1>T{i}</h1><p>A&eacute; <b>b</b>c\n {i}<p>D &lt; {i}<br>e</article>") for i in range(6)]
    data += [(50, "http://other/1", "plain text"), (51, None, None), (52, None, ""), (53, "http://other/2", "<div>x<div class=ad>buy</div><p>y</div><script>if(a<b)"), (50, "http://other/1", "plain text")]
    data += [(60, "u", "<a b" * 50_000), (61, "u", "<script " * 50_000), (62, "u", "<p " + "a='x' " * 50_000 + ">z")]
    df = spark.createDataFrame(data, "page_id bigint, url string, html string").withColumn("host", F.lit("mine")).withColumn("template", F.lit("mine"))
    got = {r["page_id"]: r for r in extract.extract(df).collect()}
    for i in range(6):
        assert got[i]["text"] == f"T{i}\nAé bc {i}\nD < {i} e"
        assert got[i]["n_chars"] == len(got[i]["text"])
    assert [got[i]["text"] for i in (50, 51, 52, 53, 62)] == ["plain text", "", "", "x\ny", "z"]
    assert extract.extract(df).count() == len(data)
    assert extract.extract(df.limit(0)).count() == 0


def test_template_is_deduced(spark):
    data = [page(i, f"<div class='x'><p>story {i} {'w ' * i}</p></div><div><p>Same on every page</p></div>") for i in range(8)]
    df = spark.createDataFrame(data, "page_id bigint, url string, html string")
    assert [r["text"] for r in sorted(extract.extract(df).collect())] == [f"story {i} {'w ' * i}".strip() for i in range(8)]


def test_articles_on_small_and_large_hosts():
    """An article with an id of its own is one whether the host has a template or not."""
    wanted = "T7\nstory 7"
    body = "<div class='date'>May {i}</div><article id='post-{i}' class='post-{i} post'><header><h1>T{i}</h1></header><p>story {i}</p></article><div>tags {i}</div>"
    for n in (3, 4, 12):
        pages = [page(i, body.replace("{i}", str(i)))[2] for i in range(n)] + [page(i, f"<p>other {i}</p>")[2] for i in range(n)]
        seen = [{k for k, *_ in extract.walk(x)} for x in pages]
        template = frozenset(k for k in set().union(*seen) if sum(k in x for x in seen) >= 1.2 * n) if n >= 4 else frozenset()
        assert extract.main_text(page(7, body.replace("{i}", "7"))[2], template) == wanted


def test_text_within_numbered_boxes_is_constant(spark):
    data = [page(i, f"<div id='page-{i}' class='c{i} x'><p>story {i} {'w ' * i}</p><p>Same on every page</p></div>") for i in range(8)]
    df = spark.createDataFrame(data, "page_id bigint, url string, html string")
    assert [r["text"] for r in sorted(extract.extract(df).collect())] == [f"story {i} {'w ' * i}".strip() for i in range(8)]


def test_wrappers_with_names_of_boxes():
    """A name of a box, or a form, around the article or most of the page does not discard it; the boxes themselves still go."""
    text = lambda body: extract.main_text(f"<html><body>{body}</body></html>", frozenset())
    story, aside = "<p>story one two three</p>", "<div class='sidebar'><p>links</p></div><div class='comments'><p>nice</p></div>"
    for wrapper in ("div class='layout has-sidebar'", "div class='page comments-open'", "form id='f'", "form class='search-form'"):
        end = f"</{wrapper.split()[0]}>"
        assert text(f"<{wrapper}><article>{story}</article>{aside}{end}") == "story one two three"
        assert text(f"<{wrapper}>{story}{aside}{end}") == "story one two three"
    widget = lambda kind, x: f"<div class='elementor-widget elementor-widget-{kind}'>{x}</div>"
    built = widget("heading", "<h1>T</h1>") + widget("text-editor", story) + widget("text-editor", "<p>four five six</p>") + widget("share", "<p>tweet</p>")
    assert text(built) == text(f"<article>{built}</article>") == "T\nstory one two three\nfour five six"
    assert text(f"<div>{story}</div><div class='comments'><p>{'nice words ' * 30}</p></div>") == "story one two three"
    cards = "<div class='related'>" + "<article><p>another story with a teaser</p></article>" * 5 + "</div>"
    assert text(f"<article>{story}</article>{cards}") == "story one two three"
    assert text(f"<article>{story}<div class='newsletter'><p>join</p></div></article><form><p>name</p></form>") == "story one two three"


def test_decontaminate_long_texts_in_linear_time():
    """A text with hits throughout: offsets of megabytes of it in seconds."""
    import time

    text = ("été aa bb " * 400_000).encode()
    automaton = decontaminate.ahocorasick.Automaton()
    automaton.add_word(" aa bb ", (7, 2, ["1"]))
    automaton.make_automaton()
    n, hit, found, starts, ends = decontaminate.scan(text, [automaton])
    began = time.perf_counter()
    spans = decontaminate.stretches(text, hit, starts, ends)
    assert time.perf_counter() - began < 5
    assert n == 1_200_000 and len(spans) == 400_000 and spans[:2] == [[4, 9], [14, 19]] and spans[-1] == [3_999_994, 3_999_999]


@pytest.mark.parametrize("contexts", [0, 1, 2048])
def test_repeats_near_the_ends_of_texts(spark, monkeypatch, contexts):
    """Copies that begin or end anywhere in a common passage, with changed bytes, counted or sorted."""
    monkeypatch.setattr(suffixes, "CONTEXTS", contexts)
    rng = random.Random(12)
    base = bytes(rng.choice(b"abcdefgh ") for _ in range(700)).decode()
    texts = [base[rng.randrange(300) : 700 - rng.randrange(250)] for _ in range(25)]
    for i in range(10, 25):
        at = rng.randrange(len(texts[i]))
        texts[i] = texts[i][:at] + "#" * (i % 3 + 1) + texts[i][at + 1 :]
    texts += [base[:200], base[:200], base[1:201], base[-200:], "é" + base[-200:], "x" * 450, "x" * 199, base[300:450] * 4]
    got = suffixes.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    got = got.select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(removed([t.encode() for t in texts]))
