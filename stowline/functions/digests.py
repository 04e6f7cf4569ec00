"""Content digests."""

from __future__ import annotations

import hashlib
from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from stowline.settings import CHUNK_BYTES

_SHA2_BITS = {"sha224": 224, "sha256": 256, "sha384": 384, "sha512": 512}


def check_algorithm(algorithm: str | None) -> str:
    """Normalised algorithm name; ValueError unless it has a fixed-length digest."""
    chosen = "sha256" if algorithm is None else algorithm.lower()
    if chosen not in hashlib.algorithms_available or chosen.startswith("shake_"):
        raise ValueError(f"Invalid hash algorithm: {algorithm!r}")
    return chosen


def content_digest(content: Column, algorithm: str | None = None) -> Column:
    """Hex digest of a string (its UTF-8 bytes) or binary column; null stays null."""
    chosen = check_algorithm(algorithm)
    if chosen in _SHA2_BITS:
        return F.sha2(content, _SHA2_BITS[chosen])
    if chosen == "sha1":
        return F.sha1(content)
    if chosen == "md5":
        return F.md5(content)

    @F.pandas_udf("string")
    def digest(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else hashlib.new(chosen, v).hexdigest())

    return digest(content.cast("binary"))


def digest_by_path(files: DataFrame, algorithm: str | None = None,
                   chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``files`` (path, size, ...) plus ``digest`` and ``error``, read on the executors.

    Each file streams through a fixed buffer, so its size does not matter. A
    path is a mounted one or a URI of a store that executors can open; its key
    is taken as it stands, not percent-decoded. A file that is gone, unreadable,
    in an unknown kind of store, or of another length than its recorded size
    (when opened, if none is recorded) gets an ``error`` and a null digest.
    """
    chosen = check_algorithm(algorithm)

    def read(path: str, size: int | None) -> tuple[str | None, str | None]:
        import hashlib

        import pyarrow as pa
        from pyarrow import fs

        from stowline.sources.stores import locate

        try:
            store, place = locate(path)
            info = store.get_file_info(place)
            if info.type != fs.FileType.File:
                return None, "missing"
            expected = info.size if size is None else size
            state, seen = hashlib.new(chosen), 0
            with store.open_input_stream(place, compression=None) as handle:
                while chunk := handle.read(chunk_bytes):
                    state.update(chunk)
                    seen += len(chunk)
        except FileNotFoundError:
            return None, "missing"
        except PermissionError:
            return None, "permission denied"
        except OSError as exc:
            return None, f"unreadable: {exc.strerror}"
        except (pa.ArrowException, ValueError) as exc:
            return None, f"unreadable: {exc}"
        return (state.hexdigest(), None) if seen == expected else (None, "size mismatch")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["size"] if "size" in batch else [None] * len(batch)
            found = [read(p, None if pd.isna(s) else int(s)) for p, s in zip(batch["path"], sizes)]
            yield batch.assign(digest=[d for d, _ in found], error=[e for _, e in found])

    schema = StructType([*files.schema.fields, StructField("digest", StringType()),
                         StructField("error", StringType())])
    return files.mapInPandas(run, schema)
