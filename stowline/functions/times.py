"""Log timestamps: UTC wall time without a zone, whatever the session zone is."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc_now() -> Column:
    return F.lit(datetime.now(timezone.utc).isoformat(sep=" ")[:26]).cast("timestamp_ntz")


def iso_utc(ts: Column) -> Column:
    """ISO-8601 with offset; the fraction has six digits and is left out when zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(ts, "SSSSSS")
    return F.concat(whole,
                    F.when(fraction == "000000", "").otherwise(F.concat(F.lit("."), fraction)),
                    F.lit("+00:00"))
