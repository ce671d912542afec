"""Running a text generator over a table of prompts (UDF-2, UDF-3, DT-4)."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Built once per Python worker; returns a function from prompts to one text each. Limits such
#: as the number of new tokens and the temperature belong to that function.
MakeGenerate = Callable[[], Callable[[list[str]], list[str]]]

_RESULT = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("duration_ms", T.DoubleType()),
    T.StructField("error", T.StringType()),
])
_ARROW_RESULT = pa.struct([("text", pa.string()), ("duration_ms", pa.float64()), ("error", pa.string())])


def _run(model, prompts: list[str], only_new: bool) -> list[dict]:
    """One timed call; a failing batch is tried again by halves, and a failing row keeps its error."""
    began = time.perf_counter()
    try:
        texts = list(model(prompts))
        if len(texts) != len(prompts):
            raise ValueError(f"{len(texts)} texts for {len(prompts)} prompts")
    except Exception as failure:
        if len(prompts) == 1:
            return [{"text": None, "duration_ms": None, "error": f"{type(failure).__name__}: {failure}"}]
        half = len(prompts) // 2
        return _run(model, prompts[:half], only_new) + _run(model, prompts[half:], only_new)
    each = (time.perf_counter() - began) * 1000 / len(prompts)
    if only_new:
        texts = [text.removeprefix(prompt) for text, prompt in zip(texts, prompts)]
    return [{"text": text, "duration_ms": each, "error": None} for text in texts]


def generate(
    df: DataFrame,
    make_generate_fn: MakeGenerate,
    batch_size: int = 16,
    prompt: str = "prompt",
    output: str = "answer",
    only_new: bool = True,
) -> DataFrame:
    """Adds the generated text, its duration and an error. Only the prompt column goes to Python.

    ``only_new`` drops the prompt from a model that repeats it. A null prompt is not sent and carries an error.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = make_generate_fn()
        for prompts in batches:
            values = [p for p in prompts.to_pylist() if p is not None]
            found: list[dict] = []
            for start in range(0, len(values), batch_size):
                found += _run(model, values[start:start + batch_size], only_new)
            rest = iter(found)
            rows = [
                next(rest) if known else {"text": None, "duration_ms": None, "error": "no prompt"}
                for known in prompts.is_valid().to_pylist()
            ]
            yield pa.array(rows, _ARROW_RESULT)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    model = F.arrow_udf(run, _RESULT).asNondeterministic()
    return df.withColumn("_generated", model(prompt)).select(
        *df.columns, F.col("_generated.text").alias(output), "_generated.duration_ms", "_generated.error"
    )


def label(df: DataFrame, make_generate_fn: MakeGenerate, batch_size: int = 16) -> DataFrame:
    """UDF-3, PRJ-7: the teacher's answer as ``response`` beside the example."""
    return generate(df, make_generate_fn, batch_size, output="response")
