"""Fixed decimals of the exact binary value."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def to_fixed(x: pd.Series) -> pd.Series:
    """Two decimals of the value the double really is: 12345.675 is a little less and gives 12345.67."""
    cent = Decimal("0.01")
    return x.map(lambda v: None if pd.isna(v) else str(Decimal(float(v)).quantize(cent, ROUND_HALF_UP)))
