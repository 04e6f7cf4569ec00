"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowline import settings
from stowline.sources.staging import most_rows, stage

WORDS = r"[^\x20\x09-\x0D]+"
#: Most bytes of a batch of whole texts on its way to Python; a longer text goes alone.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH_BYTES``, so that their memory doesn't grow with the texts."""
    number, unit = re.fullmatch(r"(\d+)([a-z]*)", spark.conf.get(_BATCH).strip().lower()).groups()
    now = int(number) * _UNITS.get(unit, BATCH_BYTES)
    if now > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


@contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside has batches of at most ``BATCH_BYTES``; the session is as before afterwards."""
    before = spark.conf.get(_BATCH)
    bound_batches(spark)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


class Memory(dict):
    """Values of a function of words. Of the words met before the last ``most``, those met again stay."""

    def __init__(self, function: Callable[[str], Any], most: int):
        super().__init__()
        self._function, self._most, self._older = function, most, {}

    def __missing__(self, word: str):
        value = self._older.get(word)
        if value is None:
            value = self._function(word)
        if len(self) >= self._most:
            self._older = dict(self)
            self.clear()
        self[word] = value
        return value


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of few rows, so that long texts don't add up in a worker."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def strings(texts: pa.Array, rows: int = 256) -> Iterator[str | None]:
    """The texts as Python strings, few of them at a time."""
    for start in range(0, len(texts), rows):
        yield from texts.slice(start, rows).to_pylist()


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder, unless it is one already."""
    return df if most_rows(df) is not None else stage(df, label)


def checked_broadcast(side: DataFrame) -> DataFrame:
    """``side`` (a staged table) with a broadcast hint while its counted rows allow it.

    Beyond the limit the hint is left out: both sides shuffle, and the adaptive
    skew join splits hot keys.
    """
    small = most_rows(side) <= settings.broadcast_rows(side.sparkSession)
    return F.broadcast(side) if small else side
