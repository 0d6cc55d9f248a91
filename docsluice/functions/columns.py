"""Measures that Spark lacks, as Arrow-batched columns. Filter with plain columns before calling one."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import similarity


def _pairwise(measure: Callable[[str, str], float]):
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else measure(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


def jaro_winkler_column(a: Column, b: Column) -> Column:
    """Null where either text is null."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known = (a.notna() & b.notna()).to_numpy()
        place, names = pd.factorize(pd.concat([a[known], b[known]], ignore_index=True))
        out = np.full(len(a), np.nan)
        out[known] = similarity.many_jaro_winkler(list(names), place[: known.sum()], place[known.sum() :])
        return pd.Series(out).where(known, None)

    return run(a, b)


def indel_ratio_column(a: Column, b: Column) -> Column:
    return _pairwise(similarity.indel_ratio)(a, b)


def partial_ratio_column(a: Column, b: Column) -> Column:
    return _pairwise(similarity.partial_ratio)(a, b)


def token_set_ratio_column(a: Column, b: Column) -> Column:
    return _pairwise(similarity.token_set_ratio)(a, b)
