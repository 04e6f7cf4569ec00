"""Trees as a data source: mounted folders and object stores.

    spark.dataSource.register(TreeSource)
    spark.read.format("stowline_tree").option("ignore", "tmp,old").load("s3a://bucket/root")

The driver looks at folder names of the first ``splitDepth`` levels only, to plan
the partitions; entries are listed by the tasks, each of which walks the subtrees it
was given. Ignored and hidden folders, depth, and a pushed prefix of ``rel_path``
prune folders before they are listed.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, StringStartsWith

from stowline.settings import IGNORED_NAMES
from stowline.sources.stores import locate, split_uri
from stowline.sources.tree import COLUMNS, lister

SCHEMA = ("path string, rel_path string, name string, extension string, size bigint, modified timestamp, "
          "error string")
_ARROW = pa.schema([("path", pa.string()), ("rel_path", pa.string()), ("name", pa.string()), ("extension", pa.string()),
                    ("size", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("error", pa.string())])


class TreeSource(DataSource):
    """Options: ``path`` (the root), ``recursive``, ``includeHidden``, ``ignore`` (names parted by commas),
    ``splitDepth`` (2) and ``partitions`` (256 at most). Rows with an ``error`` tell what could not be listed.
    ``pushdown`` (true) needs ``spark.sql.python.filterPushdown.enabled``, which ``build_session`` sets."""

    @classmethod
    def name(cls) -> str:
        return "stowline_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        pushed = str(self.options.get("pushdown", "true")).lower() == "true"
        return PrunedTreeReader(self.options) if pushed else TreeReader(self.options)


@dataclass
class Folders(InputPartition):
    """Folders to list, and whether to go on into what lies below."""

    folders: list[tuple[str, bool]]


class TreeReader(DataSourceReader):
    def __init__(self, options):
        def flag(name: str, default: str) -> bool:
            return str(options.get(name, default)).lower() == "true"

        self.root = options["path"].rstrip("/") or "/"
        self.recursive, self.hidden = flag("recursive", "true"), flag("includeHidden", "false")
        self.ignored = frozenset([*IGNORED_NAMES, *filter(None, options.get("ignore", "").split(","))])
        self.split_depth, self.most = int(options.get("splitDepth", 2)), int(options.get("partitions", 256))
        self.prefixes: list[str] = []

    def _wanted(self, folder: str) -> bool:
        below = f"{folder}/" if folder else ""
        return all(below.startswith(p) or p.startswith(below) for p in self.prefixes)

    def _entries(self, folder: str) -> Iterator[pd.DataFrame]:
        scheme, _, key = split_uri(self.root)
        if scheme == "file":
            return lister(self.ignored, self.hidden, os.path.abspath(key))(iter([pd.DataFrame({"rel_path": [folder]})]))
        return _listed(self.root, folder, self.ignored, self.hidden)

    def partitions(self) -> list[Folders]:
        _check_root(self.root)
        level, planned = [""], []
        for _ in range(self.split_depth if self.recursive else 0):
            planned += [(folder, False) for folder in level]
            level = [child for folder in level for table in self._entries(folder)
                     for child in table.loc[table["kind"] == "folder", "rel_path"] if self._wanted(child)]
        planned += [(folder, self.recursive) for folder in level]
        # Neighbours go to different tasks, since a large folder has large neighbours.
        number = max(1, min(self.most, len(planned)))
        return [Folders(planned[k::number]) for k in range(number)]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        waiting = list(partition.folders)
        while waiting:
            folder, deep = waiting.pop()
            for table in self._entries(folder):
                if deep:
                    waiting += [(child, True) for child in table.loc[table["kind"] == "folder", "rel_path"]
                                if self._wanted(child)]
                rows = table[table["kind"] != "folder"]
                if len(rows):
                    columns = [rows["path"], rows["rel_path"], rows["name"], rows["extension"],
                               rows["size"].astype("Int64"), rows["modified_us"].astype("Int64"), rows["error"]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c.tolist() if c.dtype == object else c, pa.int64() if f.name == "modified" else f.type
                                  ).cast(f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


class PrunedTreeReader(TreeReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """A folder is listed only if paths below it can pass; Spark still applies every filter."""
        for f in filters:
            if isinstance(f, (StringStartsWith, EqualTo)) and f.attribute == ("rel_path",):
                self.prefixes.append(f.value)
            yield f


def _check_root(root: str) -> None:
    """A root that cannot be listed is an error, unlike a folder below it."""
    scheme, _, key = split_uri(root)
    if scheme == "file":
        with os.scandir(key):
            return
    store, place = locate(root)
    if store.get_file_info(place).type != fs.FileType.Directory:
        raise FileNotFoundError(root)


def _listed(root: str, folder: str, ignored: frozenset, hidden: bool) -> Iterator[pd.DataFrame]:
    """The entries of one folder of a store, as :func:`stowline.sources.tree.lister` gives them; there are no links."""
    here = f"{root}/{folder}" if folder else root
    rows = []
    try:
        store, place = locate(here)
        for info in store.get_file_info(fs.FileSelector(place, recursive=False)):
            name = info.base_name
            if name in ignored or (not hidden and name.startswith(".")):
                continue
            rel = f"{folder}/{name}" if folder else name
            if info.type == fs.FileType.Directory:
                rows.append(("folder", f"{here}/{name}", rel, name, None, None, None, None))
            elif info.type == fs.FileType.File:
                modified = None if info.mtime_ns is None else info.mtime_ns // 1000
                extension = os.path.splitext(name)[1].lstrip(".").lower()
                rows.append(("file", f"{here}/{name}", rel, name, extension, info.size, modified, None))
    except (OSError, pa.ArrowException) as exc:
        reason = "Permission denied" if isinstance(exc, PermissionError) else "Cannot access"
        rows.append(("reject", here, folder, None, None, None, None, f"{reason}: {exc}"))
    yield pd.DataFrame(rows, columns=COLUMNS).astype({"size": "Int64", "modified_us": "Int64"})
