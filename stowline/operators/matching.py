"""Semi-joins that broadcast the keys only when their number is checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowline import settings
from stowline.sources.staging import most_rows


def keep_matching(rows: DataFrame, keys: DataFrame, on: list[str],
                  most_keys: int | None = None) -> DataFrame:
    """Rows whose ``on`` columns occur in ``keys``.

    ``most_keys`` bounds the rows of ``keys`` when the caller knows; otherwise
    they are counted, no further than the limit. Beyond it both sides shuffle
    and the adaptive skew join splits a hot key of ``rows``.
    """
    limit = settings.broadcast_rows(rows.sparkSession)
    wanted = keys.select(*on)
    bound = most_keys if most_keys is not None else most_rows(keys)
    if bound is not None and bound <= limit:
        return rows.join(F.broadcast(wanted), on, "left_semi")
    wanted = wanted.distinct()
    few = wanted.limit(limit + 1).count() <= limit
    return rows.join(F.broadcast(wanted) if few else wanted, on, "left_semi")
