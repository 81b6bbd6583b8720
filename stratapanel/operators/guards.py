"""Row checks that fail the job from inside the plan, so no extra action is needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def guard(df: DataFrame, holds: Column, message: Column | str) -> DataFrame:
    """Keep every row and raise ``message`` on the first one for which ``holds`` is not true."""
    text = F.lit(message) if isinstance(message, str) else message
    return df.filter(F.when(holds, F.lit(True)).otherwise(F.raise_error(text).cast("boolean")))
