"""Text of numbers as C prints them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _general(w: pd.Series) -> pd.Series:
    return w.map("%g".__mod__)


def general_format(weight: Column) -> Column:
    """`%g`: six significant digits without trailing zeros, exponents below -4 or above 5. Java's own `%g` keeps zeros and
    rounds ties otherwise, so this one is an Arrow-batched Python function; use it at a plan's end."""
    return _general(weight)
