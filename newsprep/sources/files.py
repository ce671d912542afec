"""JSON in and out, answers, prompt logs (SRC-7, SRC-8, SNK-1, SNK-4, SNK-5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsprep.functions.tokens import MakeCount
from newsprep.operators.evaluate import usage_columns
from newsprep.operators.qa import to_samples
from newsprep.schemas import LOG_FIELDS, QA_SCHEMA

from .collection import PLACE, commit_batch, committed


def read_json(spark: SparkSession, path: str, schema: T.StructType, array_file: bool = True) -> DataFrame:
    """SRC-7: JSON records. ``array_file`` reads files that hold one array; such a file is one task.

    JSON lines (``array_file=False``) split at any size, and a line may hold an array.
    """
    return spark.read.schema(schema).option("multiLine", array_file).json(path)


def read_qa(spark: SparkSession, path: str, mode: str = "training", array_file: bool = True) -> DataFrame:
    """SRC-8: question-answer samples."""
    return to_samples(read_json(spark, path, QA_SCHEMA, array_file), mode)


def write_json(df: DataFrame, path: str) -> None:
    """SNK-1: JSON lines, one part file per task."""
    df.write.mode("overwrite").json(path)


def write_answers(df: DataFrame, path: str) -> None:
    """SNK-5: the prompt and answer of every row."""
    write_json(df.select("prompt", "answer"), path)


def prompt_log(
    df: DataFrame, project: str, model: str | None = None, peft_model: str | None = None,
    variables: str = "payload", output: str = "answer", make_count: MakeCount | None = None,
) -> DataFrame:
    """SNK-4: log rows of generated answers; failed calls have no output and are left out.

    With a tokenizer the log also counts tokens.
    """
    columns = {
        "project": F.lit(project), "output": F.col(output), "variables": F.col(variables),
        "model": F.lit(model).cast("string"), "peft_model": F.lit(peft_model).cast("string"),
        **usage_columns(output=output, make_count=make_count),
    }
    fields = [*LOG_FIELDS, *(name for name in columns if name.endswith("_tokens"))]
    return df.where(F.col(output).isNotNull()).withColumns(columns).select(*fields)


def append_log(log: DataFrame, path: str, run_id: str | None = None, batch_id: int = 0) -> None:
    """SNK-4: add rows to the log table.

    With ``run_id`` the rows are one committed batch: written again, it takes the place of its first
    attempt, so a rerun leaves the log as it was, and a failed one shows nothing; ``read_log`` reads
    it. Without, they are appended as files by project and day, once for every call. A path holds logs of one of the two kinds.
    """
    dated = log.withColumn("log_date", F.current_date())
    if run_id is None:
        dated.write.mode("append").partitionBy("project", "log_date").parquet(path)
    else:
        commit_batch(dated.withColumns({"state": F.lit("ok"), "bucket": F.lit(0)}), path, run_id, batch_id)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all committed runs with ``run_id`` and ``batch_id``."""
    folders = [f"{path}/{e['folder']}/state=ok" for e in committed(spark, path).where("rows > 0").collect()]
    if not folders:
        return spark.createDataFrame([], T.StructType([*(T.StructField(c, T.StringType()) for c in LOG_FIELDS), *PLACE]))
    return spark.read.option("basePath", f"{path}/log").option("mergeSchema", True).parquet(*folders).drop("state", "attempt")
