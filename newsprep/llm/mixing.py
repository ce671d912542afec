"""Mixing sources to target weights by nested thresholds on a hash of the document.

The sizes are summed by source and hash bucket, the budget of each source is found in the running
sums of its buckets, only the bucket that holds the boundary is summed again by the next digits of
the hash, and the documents are filtered by one comparison. Nothing is sorted by document, and a
larger budget takes every document that a smaller one takes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsprep.operators.ordering import running_total

from .common import BLANK_WORD, written

#: Hexadecimal digits of the hash that name a bucket, and how often the boundary is refined.
DIGITS, LEVELS = 3, 3


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(BLANK_WORD)), F.lit(0)).cast("bigint")


def place(key: Column, text: Column) -> Column:
    """The document's fixed place between 000000000 and fffffffff: the first digits of a hash of its id."""
    return F.substring(F.md5(F.coalesce(key.cast("string"), text, F.lit(""))), 1, DIGITS * LEVELS)


def targets(totals: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size`` gets ``target``: ``share`` of all sizes dealt by weight.

    Sources in the order of their code points, null last, take the weights in turn. No target goes
    over ``most`` times its source; what is cut off is dealt to the others by weight. That is a
    level: with the sources ordered by ``most * size / weight``, a source is at its limit if its
    limit is no more than its weight's part of what all sources before it left over. Both orders
    are running totals over ranges, so that any number of sources works.
    """
    keyed = totals.select("source", "source_size", F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_name"))
    ranked = running_total(keyed, ["_none", "_name"], F.lit(1), "_rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    limited = ranked.withColumn("_weight", weight.cast("bigint")).withColumn("_ratio", F.col("source_size") / F.col("_weight"))
    order = ["_ratio", "_none", "_name"]
    before = running_total(running_total(limited, order, F.col("source_size"), "_sizes"), order, F.col("_weight"), "_weights")
    whole = totals.agg(F.sum("source_size").alias("_all_sizes"))
    # One row each: totals of the whole table.
    weighed = limited.agg(F.sum("_weight").alias("_all_weights"))
    left = F.col("_all_sizes") * F.lit(share) - F.col("_sizes") * F.lit(most)
    level = left / (F.col("_all_weights") - F.col("_weights"))
    placed = before.join(F.broadcast(whole)).join(F.broadcast(weighed)).withColumn("_level", level)
    open_ = F.col("source_size") * F.lit(most) > F.col("_weight") * F.col("_level")
    # The level that holds for every source below its limit is the one of the first such source.
    final = placed.agg(F.min_by("_level", F.when(open_, F.struct(*order))).alias("_final"))
    at_most = F.col("source_size") * F.lit(most)
    target = F.when(open_, F.col("_weight") * F.col("_final")).otherwise(at_most)
    return placed.join(F.broadcast(final)).select("source", "source_size", target.cast("double").alias("target"))


def _boundary(sums: DataFrame) -> DataFrame:
    """The bucket of each source in which its budget ends, and what of the budget reaches into it."""
    upto = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    return (
        sums.withColumn("_upto", F.sum("size").over(upto))
        .where((F.col("_upto") - F.col("size") <= F.col("budget")) & (F.col("_upto") > F.col("budget")))
        .select("source", "bucket", (F.col("budget") - (F.col("_upto") - F.col("size"))).alias("budget"), "size")
    )


def mix_plan(sized: DataFrame, **goal) -> DataFrame:
    """``source, source_size, target, copies, below`` of ``source, place, size``.

    Every document of a source is taken ``copies`` times, and once more if its place is below
    ``below``. The last refined bucket, usually one document, is taken if that brings the source
    nearer to its target.
    """
    level = written(
        sized.groupBy("source", F.substring("place", 1, DIGITS).alias("bucket")).agg(F.sum("size").alias("size")), "mix-sums"
    )
    totals = level.groupBy("source").agg(F.sum("size").alias("source_size"))
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = written(
        targets(totals, **goal).withColumn("copies", copies.cast("bigint"))
        .withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size")), "mix-targets"
    )
    budget = plan.select(F.col("source").alias("_source"), "budget")
    same = F.col("source").eqNullSafe(F.col("_source"))
    edge = written(_boundary(level.join(budget, same).drop("_source")), "mix-edge")
    for step in range(2, LEVELS + 1):
        inside = edge.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), "budget")
        within = same & (F.substring("place", 1, DIGITS * (step - 1)) == F.col("_bucket"))
        sums = (
            sized.join(inside, within)
            .groupBy("source", F.substring("place", 1, DIGITS * step).alias("bucket"))
            .agg(F.sum("size").alias("size"), F.first("budget").alias("budget"))
        )
        edge = written(_boundary(sums), "mix-edge")
    # A place equal to the bucket is below the bucket with one more character.
    cut = F.when(F.col("budget") * 2 >= F.col("size"), F.concat("bucket", F.lit("~"))).otherwise(F.col("bucket"))
    cut = edge.select(F.col("source").alias("_source"), cut.alias("below"))
    return written(plan.join(cut, same, "left").drop("_source", "budget"), "mix-plan")


def with_place(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The narrow table that the plan is made from."""
    return written(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
            place(F.col(id_col), F.col(text_col)).alias("place"), word_count(F.col(text_col)).alias("size"),
        ), "mix-sizes",
    )


def times() -> Column:
    """How often the mix takes a row that has the columns of the plan; a source without boundary has no partial copy."""
    return F.col("copies") + F.coalesce((F.col("place") < F.col("below")).cast("bigint"), F.lit(0))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **goal) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row of ``docs``.

    Null text has size 0, null source is a source of its own; rows that agree in id decide
    together, and a row without id goes by its text. Sources without words have the target 0.
    An empty table gives an empty result. Other columns are ignored.
    """
    sized = with_place(docs, id_col, text_col, source_col)
    plan = mix_plan(sized, **goal).withColumnRenamed("source", "_source")
    return sized.join(plan, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * times()).alias("taken")
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **goal) -> DataFrame:
    """The rows of the mix itself: ``docs`` with all its columns, each row as often as it is taken.

    Every row is decided by the plan of its source, so the texts are not shuffled by id. A row
    without words costs nothing and goes with its place like any other.
    """
    plan = mix_plan(with_place(docs, id_col, text_col, source_col), **goal)
    mine = plan.select(F.col("source").alias("_source"), F.struct("copies", "below").alias("_plan"))
    here = place(F.col(id_col), F.col(text_col))
    taken = F.col("_plan.copies") + F.coalesce((here < F.col("_plan.below")).cast("bigint"), F.lit(0))
    dealt = docs.join(mine, F.col(source_col).eqNullSafe(F.col("_source"))).withColumn("_times", taken)
    copies = F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))
    return dealt.where("_times > 0").select(*[F.col(f"`{c}`") for c in docs.columns], copies.alias("_copy")).drop("_copy")
