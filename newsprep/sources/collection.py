"""The vector collection: a folder in which the last write per id wins (SNK-2, SNK-3, STM-3).

Layout below the collection path::

    meta/                                        dimension, metric and number of buckets, written once
    manifest/SEQ-ATTEMPT.json                    one entry per committed batch; what has none does not exist
    log/run_id=R/batch_id=N/attempt=A/state=S/   what an attempt wrote; S is ``ok`` or ``reject``
    versions/v=K/points/bucket=B/live=L/         compacted rows by hash of the id; L tells the last write of an id from earlier ones
    versions/v=K/files/                          every file of the version, older folders included, with its least and greatest creation time
    versions/v=K/covered/                        the attempts folded in
    pointer/                                     one row per finished compaction

A batch is what its last committed attempt wrote. The view is the last write per id over all
batches, whether they are folded in or not: a version keeps the earlier writes of an id beside the
last one, so that a batch that is written again gives back what its first attempt had hidden. A
compaction rewrites only the buckets that new or replaced batches touch, and counts once its
pointer row is written.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from newsprep.functions.vectors import VECTOR, norm
from newsprep.operators.latest import latest
from newsprep.session import kept, located, removed, without_leftovers

from .sink import CollectionSink

PAYLOAD = T.StructType([
    T.StructField("headline", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("symbols", T.ArrayType(T.StringType())),
    T.StructField("author", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("text", T.StringType()),
])
POINT_SCHEMA = T.StructType([
    T.StructField("chunk_id", T.StringType()),
    T.StructField("vector", VECTOR),
    T.StructField("norm", T.DoubleType()),
    T.StructField("payload", PAYLOAD),
    T.StructField("updated_at", T.TimestampType()),
    T.StructField("article_id", T.LongType()),
    T.StructField("part", T.IntegerType()),
    T.StructField("pos", T.IntegerType()),
])
PLACE = [T.StructField("run_id", T.StringType()), T.StructField("batch_id", T.LongType()), T.StructField("attempt", T.StringType())]
_LOG = T.StructType([*POINT_SCHEMA.fields, T.StructField("error", T.StringType()), *PLACE, T.StructField("state", T.StringType())])
_STORED = T.StructType([*POINT_SCHEMA.fields, *PLACE])
_META = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("metric", T.StringType()), T.StructField("buckets", T.IntegerType())])
_POINTER = T.StructType([T.StructField("v", T.LongType())])
_BUCKETS = T.StructField("buckets", T.ArrayType(T.IntegerType()))
_ENTRY = T.StructType([*PLACE, T.StructField("seq", T.LongType()), T.StructField("folder", T.StringType()), T.StructField("rows", T.LongType()), _BUCKETS])
_COVERED = T.StructType([*PLACE, T.StructField("seq", T.LongType()), _BUCKETS])
_FILE = T.StructType([
    T.StructField("bucket", T.IntegerType()), T.StructField("live", T.BooleanType()), T.StructField("folder", T.StringType()), T.StructField("file", T.StringType()),
    T.StructField("rows", T.LongType()), T.StructField("low", T.LongType()), T.StructField("high", T.LongType()),  # microseconds
])
_BATCH = ["run_id", "batch_id"]
#: Stored rows with the place where they stand, which tells them from rows that equal them.
_STANDING = T.StructType([*_STORED.fields, T.StructField("_file", T.StringType()), T.StructField("_row", T.LongType())])
#: Buckets of a new collection, rows of a file of a version, and places of rows that are sent to every task at most as rows.
BUCKETS, FILE_ROWS, PLACES = 16, 1 << 20, 200_000
#: Rows of a file that a compaction leaves apart: it stays if its rows stand alike, else it is written again where it is read, while
#: smaller ones are put together with new rows.
APART = 3 << 12
#: Rows that a compaction shuffles before it writes them and goes on with others, and how many such rounds it makes at most.
ROUND_ROWS, ROUNDS = 1 << 19, 16
#: Of zstd in the files of a version; a tenth smaller than the usual level for a little more time.
LEVEL = 6
#: Places in one bitmap, as many as ``bitmap_construct_agg`` takes.
_BITS = 1 << 15


def _read(spark: SparkSession, path: str, schema: T.StructType, form: str = "parquet") -> DataFrame:
    """A folder, or no rows where it does not exist yet."""
    try:
        return spark.read.schema(schema).format(form).load(path)
    except AnalysisException as failure:
        if failure.getCondition() != "PATH_NOT_FOUND":
            raise
        return _table(spark, [], schema)


def _table(spark: SparkSession, rows: list, schema: T.StructType) -> DataFrame:
    """Rows that the driver holds."""
    names = schema.names
    return spark.createDataFrame(pa.Table.from_pylist([{n: r[i] for i, n in enumerate(names)} for r in rows], to_arrow_schema(schema)), schema)


def latest_points(points: DataFrame) -> DataFrame:
    """WIN-2 on points."""
    return latest(points, recency=_recency())


def latest_points_kept(points: DataFrame, folder: str) -> DataFrame:
    """``latest_points`` of rows that are kept in ``folder``: only ids, stamps and places are shuffled, the rows are chosen where they are read."""
    rows = kept(points, folder).select("*", *_where())
    last = _last(rows.select("chunk_id", _stamp().alias("_at"), "_file", "_row"))
    found = _placed(rows).join(F.broadcast(_bitmaps(last)), ["_file", "_part"], "left")
    return found.where(_bit("_winners")).select(*points.columns)


def _stamp(*more: str) -> Column:
    """Nulls are the least in a struct, as they are last in the order of writes."""
    return F.struct(*[F.col(c) if isinstance(c, str) else c for c in _recency()], *more)


def _last(narrow: DataFrame) -> DataFrame:
    """Of ``chunk_id, _at, _file, _row`` the places of the last write per id, by a maximum that each task takes first."""
    last = narrow.groupBy("chunk_id").agg(F.max(F.struct("_at", "_file", "_row")).alias("_last"))
    return last.select("_last._file", "_last._row", F.lit(True).alias("_wins"))


def _recency() -> tuple[str | Column, ...]:
    return "updated_at", F.col("payload.created_at"), "article_id", "part", "pos"


def ensure_collection(spark: SparkSession, path: str, dim: int, metric: str = "cosine", buckets: int | None = None) -> None:
    """SNK-2: record dimension, metric and number of buckets once; a second call must agree with them.

    A bucket is what a compaction reads and rewrites at least; take more for larger collections.
    """
    if metric != "cosine":
        raise ValueError(f"unknown metric {metric!r}")
    known = _meta(spark, path)
    if known is None:
        _table(spark, [(dim, metric, buckets or BUCKETS)], _META).coalesce(1).write.mode("ignore").json(f"{path}/meta")
    elif known[:2] != (dim, metric) or buckets not in (None, known[2]):
        raise ValueError(f"collection {path} has (dim, metric, buckets) {known}, not {(dim, metric, buckets)}")


def _meta(spark: SparkSession, path: str) -> tuple[int, str, int] | None:
    row = _read(spark, f"{path}/meta", _META, "json").first()
    return None if row is None else (row["dim"], row["metric"], row["buckets"] or BUCKETS)


def collection_meta(spark: SparkSession, path: str) -> tuple[int, str] | None:
    known = _meta(spark, path)
    return known and known[:2]


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("chunk_id"), F.lit(buckets)).cast("int")


def upsert(df: DataFrame, path: str, run_id: str, batch_id: int) -> None:
    """SNK-3: write one batch of points. Vectors of the wrong size go to the reject state.

    ``run_id`` names a stream checkpoint or a backfill: batch numbers start again with each. A batch
    that is written again is replaced as a whole when the new attempt is committed; until then, and
    if it fails, readers see the old one. Batches of one run are written one after the other.
    """
    spark = df.sparkSession
    meta = _meta(spark, path)
    if meta is None:
        raise ValueError(f"no collection at {path}")
    fits = F.coalesce(F.size("vector") == meta[0], F.lit(False))
    reason = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
    rows = df.withColumns({
        "norm": norm("vector"),
        "state": F.when(fits, "ok").otherwise("reject"),
        "error": F.when(~fits, F.coalesce(reason, F.lit("wrong vector size"))),
        "bucket": _bucket(meta[2]),
    })
    columns = [*(F.col(f.name).cast(f.dataType) for f in POINT_SCHEMA.fields), "error", "state", "bucket"]
    commit_batch(rows.select(*columns), path, run_id, batch_id)


def commit_batch(rows: DataFrame, path: str, run_id: str, batch_id: int) -> None:
    """Write rows with ``state`` and ``bucket`` as one batch: all of it or nothing, in place of an earlier attempt."""
    rows.sparkSession.dataSource.register(CollectionSink)
    rows.write.format("newsprep_collection").mode("append").options(
        path=path, run_id=run_id, batch_id=str(batch_id), attempt=uuid.uuid4().hex
    ).save()


def committed(spark: SparkSession, path: str) -> DataFrame:
    """The last committed attempt of each batch that the manifest still lists."""
    return latest(_read(spark, f"{path}/manifest", _ENTRY, "json").withColumn("_batch", F.struct(*_BATCH)), "_batch", ("seq", "attempt")).drop("_batch")


def _covered(spark: SparkSession, path: str, version: int) -> DataFrame:
    if version == 0:
        return _table(spark, [], _COVERED)
    return spark.read.schema(_COVERED).parquet(f"{path}/versions/v={version}/covered")


def _version(spark: SparkSession, path: str) -> int:
    row = _read(spark, f"{path}/pointer", _POINTER, "json").agg(F.max("v").alias("v")).first()
    return row["v"] or 0


@dataclass
class Snapshot:
    """A version, its files, the batches that it does not hold, and its attempts that were written again since.

    All are lists of names: files, and batches since the last compaction.
    """

    version: int
    files: list[Row]
    fresh: list[Row]
    dead: list[Row]

    def touched(self) -> list[int]:
        return sorted({b for e in (*self.fresh, *self.dead) for b in e["buckets"]})

    def hit(self) -> set[int]:
        """Buckets that hold rows of replaced attempts."""
        return {b for e in self.dead for b in e["buckets"]}


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> Snapshot:
    """What a reader sees now, or the points of an earlier version."""
    at = _version(spark, path) if version is None else version
    files = spark.read.schema(_FILE).parquet(f"{path}/versions/v={at}/files").collect() if at else []
    if version is not None:
        return Snapshot(at, files, [], [])
    folded = _covered(spark, path, at).select(*_BATCH, F.struct("attempt", "buckets", "seq").alias("_old"))
    newer = committed(spark, path).join(folded, _BATCH, "left").where(F.col("_old").isNull() | (F.col("seq") > F.col("_old.seq")))
    fresh = newer.collect()
    return Snapshot(at, files, fresh, [e["_old"] for e in fresh if e["_old"] is not None])


def _where() -> list[Column]:
    return [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]


def _fresh(spark: SparkSession, path: str, state: Snapshot) -> DataFrame:
    folders = [f"{path}/{e['folder']}/state=ok" for e in state.fresh if e["rows"]]
    if not folders:
        return _table(spark, [], _STANDING)
    return spark.read.schema(_LOG).option("basePath", f"{path}/log").parquet(*folders).select(*_STORED.names, *_where())


def _name(file: Row) -> str:
    return f"{file['folder']}/{file['file']}"


def _stored(spark: SparkSession, path: str, files: list[Row]) -> DataFrame:
    """Rows of the named files of a version."""
    if not files:
        return _table(spark, [], _STANDING)
    return spark.read.schema(_STORED).parquet(*[f"{path}/{_name(f)}" for f in files]).select(*_STORED.names, *_where())


def _alive(rows: DataFrame, state: Snapshot) -> DataFrame:
    attempts = [e["attempt"] for e in state.dead]
    return rows.where(~F.col("attempt").isin(attempts)) if attempts else rows


def _contested(spark: SparkSession, path: str, state: Snapshot) -> DataFrame:
    """The ids whose last write may have changed: those written since, and those whose last write belongs to a replaced attempt."""
    ids = _fresh(spark, path, state).select("chunk_id")
    if state.dead:
        attempts, hit = [e["attempt"] for e in state.dead], state.hit()
        lost = _stored(spark, path, [f for f in state.files if f["live"] and f["bucket"] in hit])
        ids = ids.unionAll(lost.where(F.col("attempt").isin(attempts)).select("chunk_id"))
    return ids.distinct()


def _writes(spark: SparkSession, path: str, state: Snapshot, earlier: bool, without: Iterable[str] = ()) -> DataFrame:
    """Every write in the touched buckets and since, with ``_live`` as the version has it, null for new ones, and ``_apart`` for large files.

    Without ``earlier`` the version's earlier writes are left out where no replaced attempt can have hidden them. Files named in
    ``without`` are not read.
    """
    touched, hit = set(state.touched()), state.hit()
    rows = _fresh(spark, path, state).withColumns({"_live": F.lit(None).cast("boolean"), "_apart": F.lit(False)})
    for live in (True, False):
        files = [f for f in state.files if f["live"] is live and f["bucket"] in (touched if live or earlier else hit) and _name(f) not in without]
        for apart in (True, False):
            some = [f for f in files if (f["rows"] >= APART) is apart]
            if some:
                rows = rows.unionByName(_alive(_stored(spark, path, some), state).withColumns({"_live": F.lit(live), "_apart": F.lit(apart)}))
    return rows


def _bit(bitmaps: str) -> Column:
    """Whether the bit of ``_place`` is set; a place behind the end has none."""
    byte = F.substring(F.col(bitmaps), F.shiftright("_place", 3).cast("int") + 1, F.lit(1))
    return F.coalesce(F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), F.col("_place") % 8) == 1, F.lit(False))


def _bitmaps(places: DataFrame) -> DataFrame:
    """``_file, _row, _wins`` as two bitmaps for every 32,768 rows of a file: the rows compared and those that win."""
    last = F.shiftright(F.max("_place"), 3).cast("int") + 1
    packed = _placed(places).groupBy("_file", "_part").agg(
        F.bitmap_construct_agg("_place").alias("_compared"), F.bitmap_construct_agg(F.when(F.col("_wins"), F.col("_place"))).alias("_winners"),
        last.alias("_bytes"),
    )
    return packed.select("_file", "_part", *[F.substring(F.col(c), F.lit(1), F.col("_bytes")).alias(c) for c in ("_compared", "_winners")])


def _placed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"_part": F.shiftright("_row", _BITS.bit_length() - 1), "_place": F.col("_row") % _BITS})


def _standing(spark: SparkSession, path: str, state: Snapshot, rows: DataFrame) -> tuple[DataFrame, bool]:
    """The places of the rows compared and whether they win, a row per place or, if they may be many, as ``_bitmaps``; and which of the two.

    Only ids and stamps of the contested ids are compared, however often an id was written.
    """
    narrow = rows.select("chunk_id", _stamp("batch_id", "attempt").alias("_at"), "_file", "_row")
    based = bool(state.files)
    if based:
        narrow = narrow.join(_contested(spark, path, state), "chunk_id", "left_semi")
    last = _last(narrow)
    # The rows compared are at most those of the new batches and as many of the version as there are in their buckets, both counted.
    if sum(e["rows"] for e in state.fresh) + sum(f["rows"] for f in state.files if f["bucket"] in state.touched()) > PLACES:
        if based:  # rows of other ids stand as they did
            last = last.unionByName(narrow.select("_file", "_row", F.lit(False).alias("_wins")))
        return _bitmaps(last), True
    if based:
        last = narrow.select("_file", "_row").join(last, ["_file", "_row"], "left").select("_file", "_row", F.coalesce("_wins", F.lit(False)).alias("_wins"))
    return last, False


def _marked(rows: DataFrame, places: DataFrame, packed: bool) -> DataFrame:
    """``rows`` with ``_live``: whether a write is now the last of its id. The places are broadcast: whole rows are marked where they are read."""
    if packed:
        found = _placed(rows).join(F.broadcast(places), ["_file", "_part"], "left")
        stands = F.when(_bit("_compared"), _bit("_winners")).otherwise(F.coalesce("_live", F.lit(False)))
        return found.withColumn("_live", stands).select(*rows.columns)
    return rows.join(F.broadcast(places), ["_file", "_row"], "left").withColumn("_live", F.coalesce("_wins", "_live", F.lit(False))).drop("_wins")


def _with_standing(spark: SparkSession, path: str, state: Snapshot, rows: DataFrame) -> DataFrame:
    return _marked(rows, *_standing(spark, path, state, rows))


def _alike(state: Snapshot, bitmaps: DataFrame) -> dict[str, bool]:
    """The large files of touched buckets, without rows of replaced attempts, whose rows all stand alike now: whether they are last writes."""
    buckets = set(state.touched()) - state.hit()
    large = [f for f in state.files if f["bucket"] in buckets and f["rows"] >= APART]
    if not large:
        return {}
    name = F.regexp_extract("_file", "versions/v=[0-9]+/points/[^/]+/[^/]+/[^/]+$", 0)
    bits = [F.sum(F.bitmap_count(F.col(c))).alias(c) for c in ("_compared", "_winners")]
    counted = {r["name"]: r for r in bitmaps.where(name != "").groupBy(name.alias("name")).agg(*bits).collect()}
    found = {}
    for f in large:
        r = counted.get(_name(f))
        live = (r["_winners"] if r else 0) + (f["rows"] - (r["_compared"] if r else 0) if f["live"] else 0)
        if live in (0, f["rows"]):
            found[_name(f)] = live > 0
    return found


def _rounds(rows: DataFrame, n: int) -> list[Column]:
    """Conditions that part rows by ranges of creation time, of which files in that order are not read whole; where times are few, by bucket too."""
    parts = min(ROUNDS, -(-n // ROUND_ROWS))
    if parts < 2:
        return [F.lit(True)]
    created = F.col("payload.created_at")
    at = rows.agg(F.percentile_approx(F.unix_micros(created), [i / parts for i in range(1, parts)], 10_000).alias("at")).first()["at"]
    cuts = [F.timestamp_micros(F.lit(x)) for x in sorted(set(at or ()))]
    ranges = [(created >= low) & (created < high) for low, high in zip(cuts, cuts[1:])]
    ranges = [created.isNull() | (created < cuts[0]), *ranges, created >= cuts[-1]] if cuts else [F.lit(True)]
    each = -(-parts // len(ranges))
    return [r & (F.col("bucket") % each == i) for r in ranges for i in range(each)]


def _within(created: Column, start: datetime | None, end: datetime | None) -> Column:
    inside = F.lit(True)
    if start is not None:
        inside = inside & (created >= F.lit(start))
    if end is not None:
        inside = inside & (created < F.lit(end))
    return inside


def _overlaps(file: Row, start: datetime | None, end: datetime | None) -> bool:
    if start is None and end is None:
        return True
    at = lambda x: round(x.timestamp() * 1e6)
    return file["low"] is not None and (start is None or file["high"] >= at(start)) and (end is None or file["low"] < at(end))


def read_collection(
    spark: SparkSession, path: str, start: datetime | None = None, end: datetime | None = None, version: int | None = None
) -> DataFrame:
    """The latest view: the current version and every batch it does not hold yet; or an earlier version as it was.

    With ``start`` or ``end`` (FLT-1) only points created in ``[start, end)``: files of the version that
    hold none are not opened. Buckets that no new batch touches are read as they are; in the others only ids written again are
    compared, and with few of them the version is not shuffled.
    """
    state = snapshot(spark, path, version)
    touched = set(state.touched())
    inside = _within(F.col("payload.created_at"), start, end)
    # Of a touched bucket every file counts: a write outside of the range can be the last one of an id.
    calm = [f for f in state.files if f["live"] and f["bucket"] not in touched and _overlaps(f, start, end)]
    found = _stored(spark, path, calm).select(*POINT_SCHEMA.names)
    if touched:
        rows = _with_standing(spark, path, state, _writes(spark, path, state, earlier=False)).where("_live").select(*POINT_SCHEMA.names)
        found = found.unionByName(rows) if calm else rows
    return found.where(inside)


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    """Points refused by ``upsert`` with the reason."""
    valid = committed(spark, path).select("attempt").unionAll(_covered(spark, path, _version(spark, path)).select("attempt")).distinct()
    return _read(spark, f"{path}/log", _LOG).where(F.col("state") == "reject").join(valid, "attempt", "left_semi").select(*_LOG.names)


def compact(spark: SparkSession, path: str, keep_earlier: bool = True) -> int:
    """Fold the batches since the last version into a new one and return its number; without any, the current one.

    Only buckets that they touch are read and written again; the others stay where they are, and so do large files whose rows
    all stand alike. Rows are clustered by creation time within a file. Only new rows and those of small files are shuffled to their
    bucket, in rounds: shuffle files of a round are gone before the next. Without ``keep_earlier`` only the last write of
    each id is kept: a batch written again after that no longer gives back what it had hidden.
    """
    state = snapshot(spark, path)
    if not state.fresh and state.version:
        return state.version
    number, touched = state.version + 1, set(state.touched())
    target, buckets = f"versions/v={number}", _meta(spark, path)[2]
    rows = _writes(spark, path, state, earlier=keep_earlier)
    places, packed = _standing(spark, path, state, rows)
    alike: dict[str, bool] = {}
    if packed:  # compared once, for all rounds
        places = kept(places, f"{path}/{target}/standing")
        alike = _alike(state, places)
        rows = _writes(spark, path, state, earlier=keep_earlier, without=alike)
    mine = [f for f in state.files if f["bucket"] in touched and f["rows"] < APART]
    marked = _marked(rows, places, packed).withColumnRenamed("_live", "live")
    marked = (marked if keep_earlier else marked.where("live")).withColumn("_created", F.col("payload.created_at"))
    placed = marked.withColumn("bucket", _bucket(buckets))
    # Ranges of time make the files of a bucket; where a bucket is one file of a round, its place is enough: a task of its own if there are many rows.
    n = sum(x["rows"] for x in (*mine, *state.fresh))
    together, apart = placed.where(~F.col("_apart")), placed.where("_apart")
    rounds = _rounds(rows.where(~F.col("_apart")), n)
    for i, part in enumerate(rounds):
        some = together.where(part)
        if n > len(rounds) * buckets * FILE_ROWS:
            some = some.repartitionByRange("bucket", "live", "_created")
        elif packed:
            some = some.repartitionById(2 * buckets, 2 * F.col("bucket") + F.col("live").cast("int"))
        else:
            some = some.repartition("bucket", "live")
        if i == 0 and any(f["rows"] >= APART and _name(f) not in alike for f in state.files if f["bucket"] in touched):
            some = some.unionByName(apart)
        clustered = some.sortWithinPartitions("bucket", "live", "_created", "chunk_id").select(*_STORED.names, "bucket", "live")
        with without_leftovers(spark):
            clustered.write.mode("append" if i else "overwrite").options(**{
                "compression": "zstd", "parquet.compression.codec.zstd.level": LEVEL, "maxRecordsPerFile": FILE_ROWS
            }).partitionBy("bucket", "live").parquet(f"{path}/{target}/points")
    stay = [{**f.asDict(), "live": alike.get(_name(f), f["live"])} for f in state.files if f["bucket"] not in touched or _name(f) in alike]
    _list_files(spark, path, target, [[f[c] for c in _FILE.names] for f in stay if keep_earlier or f["live"] or f["bucket"] not in touched])
    if packed:
        removed(f"{path}/{target}/standing")
    covered = _covered(spark, path, state.version)
    if state.dead:
        covered = covered.where(~F.col("attempt").isin([e["attempt"] for e in state.dead]))
    folded = _table(spark, [[e[c] for c in _COVERED.names] for e in state.fresh], _COVERED)
    covered.unionByName(folded).coalesce(1).write.mode("overwrite").parquet(f"{path}/{target}/covered")
    _table(spark, [(number,)], _POINTER).coalesce(1).write.mode("append").json(f"{path}/pointer")
    return number


def _list_files(spark: SparkSession, path: str, target: str, others: list[list]) -> None:
    """The files of a version: those just written, of which only the creation times are read, and those that stay."""
    schema = T.StructType([
        T.StructField("payload", T.StructType([PAYLOAD["created_at"]])), T.StructField("bucket", T.IntegerType()), T.StructField("live", T.BooleanType()),
    ])
    created = F.unix_micros("payload.created_at")
    found = _read(spark, f"{path}/{target}/points", schema)
    if found.inputFiles():
        found = found.groupBy("bucket", "live", F.col("_metadata.file_name").alias("file")).agg(
            F.count(F.lit(1)).alias("rows"), F.min(created).alias("low"), F.max(created).alias("high")
        ).withColumn("folder", F.concat(F.lit(f"{target}/points/bucket="), F.col("bucket"), F.lit("/live="), F.col("live").cast("string"))).select(*_FILE.names)
    else:
        found = _table(spark, [], _FILE)
    found.unionByName(_table(spark, others, _FILE)).coalesce(1).write.mode("overwrite").parquet(f"{path}/{target}/files")


def vacuum(spark: SparkSession, path: str, keep: int = 1, grace: timedelta = timedelta(days=1)) -> list[str]:
    """Delete what no reader can reach, and return the folders and files deleted, relative to the collection.

    The last ``keep`` versions stay readable, whatever folders of older versions they use, and so do
    batches that the current version does not hold. What is younger than ``grace`` stays too: it may belong
    to a write or compaction that is not finished. Rejects are kept.
    """
    finished = sorted({r["v"] for r in _read(spark, f"{path}/pointer", _POINTER, "json").collect()})
    kept = finished[-max(1, keep):]
    folders = {f["folder"] for v in kept for f in snapshot(spark, path, v).files}
    state = snapshot(spark, path)
    current = {r["attempt"] for r in committed(spark, path).select("attempt").collect()} | {
        r["attempt"] for r in _covered(spark, path, state.version).select("attempt").collect()
    }
    pending = {e["attempt"] for e in state.fresh}
    system, root = located(path)
    young = datetime.now(timezone.utc) - grace
    gone: list[str] = []

    def names(folder: str, kind=fs.FileType.Directory) -> list[str]:
        return [i.base_name for i in system.get_file_info(fs.FileSelector(f"{root}/{folder}", allow_not_found=True)) if i.type == kind]

    def drop(name: str, whole: bool = True) -> None:
        infos = system.get_file_info(fs.FileSelector(f"{root}/{name}", recursive=True)) if whole else [system.get_file_info(f"{root}/{name}")]
        if any(i.mtime is not None and i.type == fs.FileType.File and i.mtime > young for i in infos):
            return
        (system.delete_dir if whole else system.delete_file)(f"{root}/{name}")
        gone.append(name)

    for v in names("versions"):
        number = int(v.removeprefix("v="))
        if number in kept:
            continue
        used = False
        for bucket in names(f"versions/{v}/points"):
            for live in names(f"versions/{v}/points/{bucket}"):
                folder = f"versions/{v}/points/{bucket}/{live}"
                if folder in folders:
                    used = True
                else:
                    drop(folder)
        if not used:
            drop(f"versions/{v}")
    for run in names("log"):
        for batch in names(f"log/{run}"):
            for attempt in names(f"log/{run}/{batch}"):
                name, folder = attempt.removeprefix("attempt="), f"log/{run}/{batch}/{attempt}"
                if name not in current:
                    drop(folder)
                elif name not in pending and "state=ok" in names(folder):
                    drop(f"{folder}/state=ok")
    for entry in sorted(names("manifest", fs.FileType.File)):  # the oldest first, so that no replaced attempt comes back
        attempt = entry.removesuffix(".json").rsplit("-", 1)[-1].removeprefix("_")
        if attempt not in pending:  # folded in, replaced, or never finished
            drop(f"manifest/{entry}", whole=False)
    return gone
