"""Polished report texts and the guardrail they must pass."""

from __future__ import annotations

from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from ..functions.text import contains_any

Polish = Callable[[Iterator[pd.Series]], Iterator[pd.Series]]


def guardrail_ok(text: Column) -> Column:
    """The required phrase occurs and none of the forbidden words does, ignoring case."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    return F.contains(lower, F.lit(fv.GUARDRAIL_REQUIRED)) & ~contains_any(lower, fv.GUARDRAIL_FORBIDDEN)


def filter_guardrail(rows: DataFrame, polished: str, template: str, out: str = "text") -> DataFrame:
    """The polished text where it passes, else the template text."""
    return rows.withColumn(out, F.when(guardrail_ok(F.col(polished)), F.col(polished)).otherwise(F.col(template)))


def polish_descriptions(rows: DataFrame, template: str, polish: Polish | None, out: str = "text") -> DataFrame:
    """Run a user's text function over Arrow batches, then the guardrail."""
    if polish is None:
        return rows.withColumn(out, F.col(template))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from polish(batches)

    udf = F.pandas_udf(run, "string")
    return filter_guardrail(rows.withColumn("__p", udf(F.col(template))), "__p", template, out).drop("__p")
