"""Files of fixed-width records as a Python data source, in batch and as a stream.

``spark.read.format("vendor_records")`` with the options ``path``, ``glob`` and ``layout``. A file of any size is read by many tasks, each a
range of whole records (RANGE_BYTES), and small files are read many by one task (PACK_FILES); bounds on whole-number columns are checked before a row leaves Python, and a range whose first and
last record lie outside a bound on the sorted column is not read. As a stream the offset is the number of whole records of each file, so
``update`` of a feed is what was appended since: grown files give their new records, new files all of theirs.

Folders are listed and read through Arrow's file systems (local or shared mounts, hdfs, s3, gs).
"""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual)

NAME = "vendor_records"
RANGE_BYTES = 64 << 20
PACK_FILES = 256
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
_ROWS = 1 << 16


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, and its path there."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


@dataclass
class Range(InputPartition):
    """Records ``start`` to below ``end`` of a file."""

    path: str
    start: int
    end: int


@dataclass
class Pack(InputPartition):
    """Ranges that one task reads: many small files share one."""

    parts: list[Range]


def packs(parts: list[Range], size: int, most: int = RANGE_BYTES) -> list[Pack]:
    """Ranges in their order, ``most`` bytes and PACK_FILES ranges a task at most."""
    out, held = [], 0
    for part in parts:
        n = (part.end - part.start) * size
        if not out or held + n > most or len(out[-1].parts) == PACK_FILES:
            out.append(Pack([]))
            held = 0
        out[-1].parts.append(part)
        held += n
    return out


def listed(path: str, glob: str, size: int) -> dict[str, int]:
    """Whole records of every file below the folder whose name fits."""
    system, root = store(path)
    infos = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return {i.path: i.size // size for i in infos if i.is_file and fnmatch.fnmatch(i.base_name, glob)}


def ranges(files: dict[str, int], size: int, since: dict[str, int] | None = None, most: int = RANGE_BYTES) -> list[Range]:
    step, since = max(1, most // size), since or {}
    return [Range(name, a, min(a + step, n)) for name, n in sorted(files.items()) for a in range(since.get(name, 0), n, step)]


class Records:
    """Decodes ranges of records; ``bounds``: column -> least and greatest value wanted."""

    def __init__(self, options: dict[str, str], dtype: np.dtype):
        self.path, self.glob = options["path"], options.get("glob", "*")
        self.most = int(options.get("range_bytes", RANGE_BYTES))
        self.dtype, self.sorted_by = dtype, options.get("sorted_by")
        self.bounds: dict[str, tuple[int | None, int | None]] = {}

    def read(self, pack: Pack | None) -> Iterator[pa.RecordBatch]:
        if pack is None:  # how Spark asks where there is nothing to read
            return
        system, _ = store(self.path)
        small: list[pa.RecordBatch] = []
        for part in pack.parts:
            with system.open_input_file(part.path) as file:
                if not self._outside(file, part):
                    for a in range(part.start, part.end, _ROWS):
                        small += self._batch(part.path, a, self._records(file, a, min(a + _ROWS, part.end)))
                        if sum(b.num_rows for b in small) >= _ROWS // 4:  # the rows of many small files go on together
                            yield pa.concat_batches(small)
                            small = []
        if small:
            yield pa.concat_batches(small)

    def _records(self, file, start: int, end: int) -> np.ndarray:
        return np.frombuffer(file.read_at((end - start) * self.dtype.itemsize, start * self.dtype.itemsize), self.dtype)

    def _outside(self, file, part: Range) -> bool:
        low, high = self.bounds.get(self.sorted_by, (None, None)) if self.sorted_by else (None, None)
        if low is None and high is None:
            return False
        first, last = (int(self._records(file, k, k + 1)[self.sorted_by][0]) for k in (part.start, part.end - 1))
        return low is not None and last < low or high is not None and first > high

    def _batch(self, path: str, first: int, data: np.ndarray) -> Iterator[pa.RecordBatch]:
        number = np.arange(first, first + len(data))
        keep = np.ones(len(data), bool)
        for name, (low, high) in self.bounds.items():
            value = data[name].astype(np.int64)
            keep &= (value >= low if low is not None else True) & (value <= high if high is not None else True)
        data, number = data[keep], number[keep]
        if len(data):
            columns = [data[n].astype(np.float64 if self.dtype[n].kind == "f" else np.int64) for n in self.dtype.names]
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(data)), pa.array(number), *map(pa.array, columns)], ["path", "record", *self.dtype.names])


class RecordReader(DataSourceReader):
    def __init__(self, records: Records):
        self.records = records

    def partitions(self) -> list[Pack]:
        r = self.records
        return packs(ranges(listed(r.path, r.glob, r.dtype.itemsize), r.dtype.itemsize, most=r.most), r.dtype.itemsize, r.most)

    def read(self, partition: Pack) -> Iterator[pa.RecordBatch]:
        return self.records.read(partition)


class FilteringReader(RecordReader):
    """Takes bounds on whole-number columns over from the query."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            whole = name in (self.records.dtype.names or ()) and self.records.dtype[name].kind == "u" and isinstance(getattr(f, "value", None), int)
            change = {EqualTo: (0, 0), GreaterThan: (1, None), GreaterThanOrEqual: (0, None), LessThan: (None, -1), LessThanOrEqual: (None, 0)}.get(type(f))
            if not whole or change is None:
                yield f
                continue
            low, high = self.records.bounds.get(name, (None, None))
            more, less = (None if c is None else f.value + c for c in change)
            self.records.bounds[name] = (more if low is None else low if more is None else max(low, more), less if high is None else high if less is None else min(high, less))


class RecordStream(DataSourceStreamReader):
    """What files have gained."""

    def __init__(self, records: Records):
        self.records = records

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        return {"files": json.dumps(listed(self.records.path, self.records.glob, self.records.dtype.itemsize), sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Pack]:
        r = self.records
        return packs(ranges(json.loads(end["files"]), r.dtype.itemsize, json.loads(start["files"]), r.most), r.dtype.itemsize, r.most)

    def read(self, partition: Pack) -> Iterator[pa.RecordBatch]:
        return self.records.read(partition)


class RecordSource(DataSource):
    """Options: path, glob, layout (JSON of names and numpy kinds), sorted_by, range_bytes, pushdown."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def _dtype(self) -> np.dtype:
        return np.dtype([tuple(f) for f in json.loads(self.options["layout"])])

    def schema(self) -> str:
        dtype = self._dtype()
        kinds = {"u": "bigint", "i": "bigint", "f": "double"}
        return "path string, record bigint, " + ", ".join(f"{n} {kinds[dtype[n].kind]}" for n in dtype.names)

    def reader(self, schema) -> DataSourceReader:
        kind = FilteringReader if self.options.get("pushdown") == "true" else RecordReader
        return kind(Records(dict(self.options), self._dtype()))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return RecordStream(Records(dict(self.options), self._dtype()))


def layout_text(dtype: np.dtype) -> str:
    return json.dumps([[n, dtype[n].str] for n in dtype.names])


def options_of(spark: SparkSession, path: str, dtype: np.dtype, glob: str, sorted_by: str | None) -> dict[str, str]:
    """Registers the source and gives its options; filters are pushed where the session allows it."""
    spark.dataSource.register(RecordSource)
    options = {"path": path, "glob": glob, "layout": layout_text(dtype), "pushdown": str(spark.conf.get(PUSHDOWN, "false")).lower()}
    return options | ({"sorted_by": sorted_by} if sorted_by else {})
