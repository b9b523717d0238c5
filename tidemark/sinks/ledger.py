"""Append-only tables that know the last time of every key without reading their rows.

Layout below the table's folder: ``data/<name>`` holds the rows of one append, ``last/<name>`` the last time per key after it, and
``commits/<number>`` one line that names the append. A commit file is created whole and only if it does not exist yet, so an append counts
from that moment on or not at all: what a crashed run wrote before stays unnamed and unread. An append reads the newest ``last``
table and the commit names, never the rows. A batch id that is committed already adds nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Commits after which one commit names all appends so far, so that a reader lists no more files than that.
SUMMARY_EVERY = 64


class Ledger:
    """``schema``: of the rows; ``keys`` and ``t``: only rows after the last ``t`` of their keys are added."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], t: str):
        self.spark, self.path, self.schema, self.keys, self.t = spark, path.rstrip("/"), schema, keys, t
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _commits(self) -> dict[int, dict]:
        """The commits from the last summary on, by number."""
        folder = self._path(f"{self.path}/commits")
        if not self._fs.exists(folder):
            return {}
        numbers = sorted(int(f.getPath().getName()) for f in self._fs.listStatus(folder) if f.getPath().getName().isdigit())
        first = max([n for n in numbers if n % SUMMARY_EVERY == 0], default=0)
        return {n: json.loads(self._read(f"{self.path}/commits/{n:012d}")) for n in numbers if n >= first}

    def _read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _commit(self, number: int, entry: dict) -> None:
        """Ends with an error if another run has taken the number: creating a file that exists is refused."""
        stream = self._fs.create(self._path(f"{self.path}/commits/{number:012d}"), False)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()

    def last(self) -> DataFrame | None:
        """keys and the last ``t`` of each, or None before the first append."""
        commits = self._commits()
        if not commits:
            return None
        names = [f for f in self.schema.fields if f.name in (*self.keys, self.t)]
        return self.spark.read.schema(StructType(names)).parquet(f"{self.path}/last/{commits[max(commits)]['name']}")

    def append(self, new: DataFrame, batch: str) -> bool:
        """Add the newer rows of ``new`` under a batch id; False if that id is committed."""
        commits = self._commits()
        done = {b for c in commits.values() for b in c["batches"]}
        if batch in done:
            return False
        new, last, name = new.select(*self.schema.names), self.last(), uuid.uuid4().hex
        if last is not None:
            known = last.withColumnRenamed(self.t, "_last")
            new = new.join(known, self.keys, "left").where(F.col("_last").isNull() | (F.col(self.t) > F.col("_last"))).select(*self.schema.names)
        new.write.parquet(f"{self.path}/data/{name}")
        added = self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{name}").select(*self.keys, self.t)
        both = added if last is None else added.unionByName(last.select(*self.keys, self.t))
        both.groupBy(*self.keys).agg(F.max(self.t).alias(self.t)).write.parquet(f"{self.path}/last/{name}")
        number = max(commits, default=-1) + 1
        entry = {"name": name, "batches": [batch], "names": [name]}
        if number % SUMMARY_EVERY == 0:
            entry["names"] = [n for c in commits.values() for n in c["names"]] + [name]
            entry["batches"] = [b for c in commits.values() for b in c["batches"]] + [batch]
        self._commit(number, entry)
        return True

    def rows(self) -> DataFrame:
        """The committed rows."""
        names = [n for c in self._commits().values() for n in c["names"]]
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{n}" for n in names])
