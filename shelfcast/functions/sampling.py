"""Samples of a fixed size that do not depend on how the rows are dealt out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def bottom_k(df: DataFrame, n: int, keys: list[str], seed: str = "sample") -> DataFrame:
    """Exactly `n` rows (all, if fewer): those with the smallest hash of `keys`.

    Every row is equally likely, and reruns agree. Samples merge: the bottom n of the bottom n of the
    parts are those of the whole, so each task keeps at most n rows and only these travel. Rows that
    agree in `keys` follow one another; nulls count as a value of their own.
    """
    named = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in keys]
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(seed), *named)), *[F.col(c).asc_nulls_first() for c in keys]).limit(n)
