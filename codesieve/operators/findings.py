"""The flat finding table shared by all detectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.schemas import FINDING_FIELDS


def as_findings(df: DataFrame, **values: Column | str | int | None) -> DataFrame:
    """Select the finding columns: given values, then columns of ``df``, then typed nulls."""
    out = []
    for name, kind in FINDING_FIELDS.items():
        if name in values:
            value = values[name]
            column = value if isinstance(value, Column) else F.lit(value)
        elif name in df.columns:
            column = F.col(f"`{name}`")
        else:
            column = F.lit(None)
        out.append(column.cast(kind).alias(name))
    return df.select(*out)


def union_findings(*frames: DataFrame) -> DataFrame:
    """UNION ALL of finding families; missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
