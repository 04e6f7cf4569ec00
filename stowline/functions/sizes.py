"""Byte counts for people."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def human_size(size: Column) -> Column:
    """``512 B``, ``1.2 KB`` ... in steps of 1024, never beyond TB.

    The one decimal rounds half to even on the exact binary value, which
    ``bround`` does and plain formatting does not.
    """
    size = F.greatest(size, F.lit(0)).cast("double")

    def scaled(power: int, unit: str) -> Column:
        return F.format_string(f"%.1f {unit}", F.bround(size / F.lit(float(1024 ** power)), 1))

    text = F.when(size < 1024, F.format_string("%d B", size.cast("bigint")))
    text = reduce(
        lambda done, step: done.when(size < float(1024 ** (step[0] + 1)), scaled(*step)),
        [(1, "KB"), (2, "MB"), (3, "GB")], text)
    return text.otherwise(scaled(4, "TB"))
