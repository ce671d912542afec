"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsprep.session import configure, ship

from . import decontaminate as leak
from . import extract, langid, licenses, mixing, neardup, quality, resample, sharding, spelling, suffixes, surrogates, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL where SQL can say it."""

    def register(body):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(configure(spark), "newsprep")
            return body(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        run.__doc__ = body.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return body

    return register


@query("op4_exact_top_k", r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
      FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def op4(table) -> DataFrame:
    vectors = table("embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


@query("op6_mixing", r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
             substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 9) AS place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w
      FROM d GROUP BY source),
o AS (SELECT *, coalesce(sum(source_size) OVER b, 0) AS sizes, coalesce(sum(w) OVER b, 0) AS weights, sum(source_size) OVER () AS all_sizes, sum(w) OVER () AS all_weights
      FROM s WINDOW b AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (all_sizes * 1.5::DOUBLE - sizes * 2.0::DOUBLE) / (all_weights - weights) AS level FROM o),
f AS (SELECT arg_min(level, source_size / w) FILTER (source_size * 2.0::DOUBLE > w * level) AS final FROM l),
t AS (SELECT source, source_size, CASE WHEN source_size * 2.0::DOUBLE > w * level THEN w * final ELSE source_size * 2.0::DOUBLE END AS target FROM l, f),
c AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM t),
g AS (SELECT source, place, sum(size) AS size FROM d GROUP BY 1, 2),
u AS (SELECT source, place, size, sum(size) OVER (PARTITION BY source ORDER BY place) - size AS before FROM g)
SELECT d.doc_id, d.size, c.source_size, c.target,
       CAST(d.size * (c.copies + CASE WHEN 2 * (c.target - c.copies * c.source_size - u.before) >= u.size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source JOIN u ON d.source IS NOT DISTINCT FROM u.source AND d.place = u.place""")
def op6(table) -> DataFrame:
    return mixing.mix(table("documents"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op7_decontamination", rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w, least(len(w), 10) AS k FROM benchmark WHERE len(w) > 0),
p AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS run FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
g AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS run
      FROM (SELECT d.doc_id, d.w, n.k, unnest(range(1, len(d.w) - n.k + 2)) AS i FROM d, (SELECT DISTINCT k FROM p) n)),
m AS (SELECT g.doc_id, g.i, g.k, p.item_id FROM g JOIN p ON g.k = p.k AND g.run = p.run),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS x FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY 1)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""")
def op7(table) -> DataFrame:
    found = leak.decontaminate(table("documents").select("doc_id", "text"), table("benchmark"))
    return found.select(
        "doc_id", "found.n_words", "found.n_hit", F.size("found.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"), (F.col("found.n_hit") > 0).alias("contaminated"),
    )


#: The 256 remainders of the checksum, and the checksum of a text's UTF-8 bytes, which this SQL has no function for.
_CRC_TABLE = """crc AS (SELECT list(v ORDER BY k) AS remainders FROM (
  SELECT k, list_reduce([k] || range(8), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(k)))"""


def _crc(text: str) -> str:
    step = "lambda a, b: xor(a >> 8, remainders[CAST(xor(a & 255, b) AS INT) + 1])"
    return f"xor(list_reduce([4294967295] || list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT)), {step}), 4294967295)"


@query("op8_sharding", f"""
WITH {_CRC_TABLE}, d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, {_crc("coalesce(text, '')")} AS text_crc32 FROM documents, crc),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id) - size AS before, sum(size) OVER () AS total, row_number() OVER (ORDER BY doc_id) AS n FROM d),
s AS (SELECT *, CAST(least(((2 * before + size) * 16) // (2 * total), 15) AS INT) AS shard FROM p)
SELECT doc_id, size, text_crc32, shard, n - min(n) OVER (PARTITION BY shard) AS slot, 'bytes' AS law, CAST(NULL AS INT) AS grown_shard FROM s""")
def op8(table) -> DataFrame:
    return sharding.shard(table("documents"))


@query("op1_language_id")
def op1(table) -> DataFrame:
    docs = table("documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "language.lang_pred", "language.score")


@query("op3_license_scan")
def op3(table) -> DataFrame:
    found = licenses.scan_licenses(table("documents").select("doc_id", "text"))
    return found.select("doc_id", "licenses.*")


#: The secret of the registered query; a user passes their own.
SECRET = b"public test secret"


@query("op10_surrogates")
def op10(table) -> DataFrame:
    found = surrogates.with_surrogates(table("documents").select("doc_id", "text"), SECRET)
    return found.select(
        "doc_id", "text", F.size("entities").cast("bigint").alias("n_entities"),
        F.array_join(F.array_sort(F.array_distinct("entities.kind")), ",").alias("kinds"),
        F.transform("entities", lambda e: F.struct(e.kind.alias("kind"), e.surrogate.alias("surrogate"), e.start.alias("start"))).alias("entities"),
    )


#: All columns but the component, which needs recursion over links; the tests close it over.
LINKS_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 3) - 1], ' ') AS x FROM (SELECT *, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2)
SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)"""
_CLOSED = "WITH RECURSIVE l AS (" + LINKS_SQL + r"""),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY 1),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 3) - 1], ' ') AS x FROM (SELECT *, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""


@query("op9_near_duplicates", _CLOSED)
def op9(table) -> DataFrame:
    return neardup.near_duplicates(table("documents"))


@query("op2_main_text")
def op2(table) -> DataFrame:
    return extract.extract(table("pages"))


@query("op5_suffix_dedup", """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
u AS (SELECT doc_id, n, j, substr(h, 4000 * j + 1, 4400) AS part FROM (SELECT *, unnest(range((n + 1800) // 2000)) AS j FROM d)),
s AS (SELECT doc_id, 2000 * j + i AS i, md5(substr(part, 2 * i + 1, 400)) AS x FROM (SELECT *, unnest(range(least(2000, n - 199 - 2000 * j))) AS i FROM u)),
r AS (SELECT doc_id, i FROM s JOIN (SELECT x FROM s GROUP BY x HAVING count(*) > 1) USING (x)),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM r),
k AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g),
p AS (SELECT doc_id, span, min(i) AS a, max(i) + 200 AS b FROM k GROUP BY 1, 2),
c AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM p),
t AS (SELECT c.doc_id, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed, max(b) AS after,
             string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM c JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(after, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)""")
def op5(table) -> DataFrame:
    found = suffixes.remove_repeats(table("documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op11_spelling_variants", rf"""
WITH RECURSIVE {_CRC_TABLE},
o AS (SELECT doc_id, run, count(*) AS n, len(run) AS k FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY 1, 2),
h AS (SELECT run, n, k, {_crc("doc_id || ':' || run")} AS h FROM o, crc),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % k) || substr(run, h % k + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE len(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
d AS (SELECT DISTINCT word, substr(word, 1, i) || substr(word, i + 2) AS x FROM (SELECT word, unnest(range(len(word))) AS i FROM v)),
g AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS x FROM (SELECT word, unnest(range(len(word))) AS i FROM v)),
p AS (SELECT d.word AS a, v.word AS b FROM d JOIN v ON d.x = v.word UNION SELECT v.word, d.word FROM d JOIN v ON d.x = v.word
      UNION SELECT s.word, t.word FROM g s JOIN g t ON s.x = t.x AND s.i = t.i AND s.word <> t.word),
m AS (SELECT p.a AS word, p.b, y.n AS b_n, z.n, count(*) OVER (PARTITION BY p.a) AS n_near,
             row_number() OVER (PARTITION BY p.a ORDER BY y.n DESC, p.b) AS place FROM p JOIN v y ON y.word = p.b JOIN v z ON z.word = p.a),
f AS (SELECT word, n_near, CASE WHEN b_n >= 5 * n THEN b END AS form, CASE WHEN b_n >= 5 * n THEN b_n END AS form_n FROM m WHERE place = 1),
c(word, reached) AS (SELECT word, word FROM v UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.reached WHERE f.form IS NOT NULL),
r AS (SELECT c.word, c.reached AS root FROM c LEFT JOIN f ON f.word = c.reached WHERE f.form IS NULL)
SELECT v.word, f.form, r.root, v.n, coalesce(f.n_near, 0) AS n_near, f.form_n FROM v LEFT JOIN f USING (word) JOIN r USING (word)""")
def op11(table) -> DataFrame:
    return spelling.spelling_variants(table("documents"), noise=199)


@query("op12_quality")
def op12(table) -> DataFrame:
    docs, labels = table("documents").select("doc_id", "text"), table("labels")
    model = quality.train(docs, labels.where(~langid.held_out(F.col("doc_id"))), "quality", at=0.3)
    return quality.score(docs, model).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "quality.score", "quality.predicted")


@query("op13_importance_resampling", rf"""
WITH {_CRC_TABLE},
w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
d AS (SELECT doc_id, len(w) AS n_words, w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS f FROM w),
b AS (SELECT w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS f FROM (SELECT {_WORDS} AS w FROM benchmark)),
e AS (SELECT doc_id, unnest(f) AS x FROM d), g AS (SELECT unnest(f) AS x FROM b),
k AS (SELECT x, {_crc("x")} % 10000 AS bucket FROM (SELECT x FROM e UNION SELECT x FROM g), crc),
s AS (SELECT bucket, count(*) AS s FROM e JOIN k USING (x) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM g JOIN k USING (x) GROUP BY 1),
u AS (SELECT i AS bucket, CAST(coalesce(s, 0) AS DOUBLE) AS s, CAST(coalesce(t, 0) AS DOUBLE) AS t, sum(coalesce(s, 0)) OVER () AS s_all, sum(coalesce(t, 0)) OVER () AS t_all
      FROM range(10000) r(i) LEFT JOIN s ON s.bucket = i LEFT JOIN t ON t.bucket = i),
q AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (CAST(s_all AS DOUBLE) + 10000) / ((s + 1) * (CAST(t_all AS DOUBLE) + 10000)))) AS BIGINT) AS gain FROM u),
m AS (SELECT doc_id, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM e JOIN k USING (x) JOIN q USING (bucket) GROUP BY 1),
z AS (SELECT doc_id, n_words, CAST(len(f) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
             CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN m USING (doc_id)),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM z),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM y WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank FROM y LEFT JOIN o USING (doc_id)""")
def op13(table) -> DataFrame:
    return resample.resample(table("documents"), table("benchmark"))
