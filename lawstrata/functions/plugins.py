"""Plug points for models: tokenizers, embedders, pair scorers, text generators.

A plug is a plain function of a batch. It is applied to Arrow batches, never row by row from the JVM,
and its failures become values: a failing row has an error and no result, the others go on.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRIES, WAIT = 3, 3.0


class Busy(Exception):
    """Raised by a model that may be asked again."""


def tokenizer(count: Callable[[str], int]) -> Callable[[Column], Column]:
    """A size function for the chunker from ``count(text)``; null counts as null."""

    @F.pandas_udf("int")
    def size(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else count(x)).astype("Int32")

    return lambda col: size(col)


def scorer(score: Callable[[list[str], list[str]], list[float]]) -> Callable[[Column, Column], Column]:
    """A rerank score from ``score(questions, texts)``, asked once for each batch."""

    @F.pandas_udf("double")
    def scored(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(score(a.fillna("").tolist(), b.fillna("").tolist()), dtype="float64")

    return lambda a, b: scored(a, b)


def asked_model(model: Callable[[str], str], prompt: str, tries: int, wait: float) -> tuple[str | None, str | None]:
    """(reply, error). A busy model is asked again, ``tries`` times in all; any other failure is final."""
    for k in range(tries):
        try:
            return model(prompt), None
        except Busy as e:
            if k + 1 == tries:
                return None, f"busy: {e}"
            time.sleep(wait)
        except Exception as e:  # one row's failure must not end the others
            return None, f"{type(e).__name__}: {e}"
    return None, "not asked"


def with_replies(df: DataFrame, prompt_col: str, model: Callable[[str], str], tries: int = TRIES, wait: float = WAIT) -> DataFrame:
    """``df`` with ``reply`` and ``error``; a null prompt has neither."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [(None, None) if p is None else asked_model(model, p, tries, wait) for p in b.column(prompt_col).to_pylist()]
            yield b.append_column("reply", pa.array([p[0] for p in pairs], pa.string())).append_column("error", pa.array([p[1] for p in pairs], pa.string()))

    return df.mapInArrow(run, T.StructType(list(df.schema.fields)).add("reply", "string").add("error", "string"))
