"""Normal distribution functions as Arrow batch UDFs (Spark has no erf)."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_cdf(z: Column) -> Column:
    @F.pandas_udf("double")
    def cdf(s: pd.Series) -> pd.Series:
        return s.map(lambda v: 0.5 * math.erfc(-v / math.sqrt(2.0)), na_action="ignore").astype("float64")

    return cdf(z.cast("double"))


def norm_ppf(p: Column) -> Column:
    @F.pandas_udf("double")
    def ppf(s: pd.Series) -> pd.Series:
        unit = NormalDist()
        return s.map(lambda v: unit.inv_cdf(v) if 0.0 < v < 1.0 else None, na_action="ignore").astype("float64")

    return ppf(p.cast("double"))
