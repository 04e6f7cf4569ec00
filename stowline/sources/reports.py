"""Reports as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def write_report(lines: DataFrame, path: str, order: list[Column | str]) -> None:
    """Column ``line`` in order as UTF-8 text, in place of whatever is there.

    A sorted write gives part files whose names follow the order.
    """
    lines.orderBy(*order).select("line").write.mode("overwrite").text(path)
