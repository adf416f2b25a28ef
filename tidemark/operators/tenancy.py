"""Listings within a tenant."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.ids import belongs, unqualify


def owned(df: DataFrame, tenant: str | None, columns: list[str]) -> DataFrame:
    """The rows whose first column's id is the tenant's, with external ids in all ``columns``."""
    t = F.lit(tenant).cast("string")
    return df.where(belongs(t, F.col(columns[0]))).withColumns({c: unqualify(t, F.col(c)) for c in columns})
