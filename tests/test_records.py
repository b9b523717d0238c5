"""The data source of record files: ranges, bounds and what files gain."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.sources import fixed_width as X
from tidemark.sources import records as R


def daily(days):
    out = np.zeros(len(days), X.DAILY)
    out["date"], out["close"] = days, np.arange(len(days))
    return out.tobytes()


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sh600000.day").write_bytes(daily(range(20200101, 20200131)))
    (tmp_path / "sub" / "sz000001.day").write_bytes(daily(range(20200111, 20200121)) + b"cut")  # a record that is not whole yet
    (tmp_path / "empty.day").write_bytes(b"")
    (tmp_path / "other.txt").write_bytes(b"x" * 64)
    return tmp_path


def test_a_file_is_read_in_many_ranges(spark, folder):
    options = R.options_of(spark, str(folder), X.DAILY, "*.day", "date") | {"range_bytes": str(32 * 7)}
    rows = spark.read.format(R.NAME).options(**options).load()
    assert rows.rdd.getNumPartitions() == 5 + 2
    got = sorted((r.path.rsplit("/", 1)[1], r.record, r.date, r.close) for r in rows.collect())
    assert got == [("sh600000.day", i, 20200101 + i, i) for i in range(30)] + [("sz000001.day", i, 20200111 + i, i) for i in range(10)]
    assert X.read_records(spark, f"file://{folder}", "daily", "*.day").count() == 40
    assert X.read_records(spark, str(folder / "none"), "daily").count() == 0


def test_bounds_reach_the_reader(spark, folder, tmp_path):
    rows = X.read_records(spark, str(folder), "daily", "*.day").where("date >= 20200105 and date < 20200113 and close <> 5 and amount >= 0")
    assert sorted(r.date for r in rows.collect()) == sorted([*[x for x in range(20200105, 20200113) if x != 20200106], 20200111, 20200112])
    reader = R.FilteringReader(R.Records({"path": str(folder), "glob": "*.day", "sorted_by": "date"}, X.DAILY))
    rest = list(reader.pushFilters([R.GreaterThanOrEqual(("date",), 20200105), R.LessThan(("date",), 20200113), R.EqualTo(("path",), "x"), R.LessThan(("amount",), 1)]))
    assert len(rest) == 2 and reader.records.bounds == {"date": (20200105, 20200112)}
    reader.records.bounds = {"date": (20210101, None)}
    (part, *_) = reader.partitions()
    reader.records._batch = None  # a range outside the bounds is never decoded
    assert list(reader.read(part)) == []


def test_a_stream_gives_what_files_gain(spark, folder, tmp_path_factory):
    out = tmp_path_factory.mktemp("out")

    def run():
        stream = X.stream_records(spark, str(folder), "daily", "*.day")
        stream.writeStream.format("parquet").option("checkpointLocation", str(out / "cp")).trigger(availableNow=True).start(str(out / "t")).awaitTermination()
        return spark.read.schema(stream.schema).parquet(str(out / "t")).groupBy(F.regexp_extract("path", r"([^/]+)\.day$", 1).alias("f")).agg(
            F.count("*").alias("n"), F.countDistinct("record").alias("d")).collect()

    assert {r.f: (r.n, r.d) for r in run()} == {"sh600000": (30, 30), "sz000001": (10, 10)}
    with open(folder / "sh600000.day", "ab") as f:
        f.write(daily(range(20200201, 20200206)))
    (folder / "bj830001.day").write_bytes(daily([20200101]))
    assert {r.f: (r.n, r.d) for r in run()} == {"sh600000": (35, 35), "sz000001": (10, 10), "bj830001": (1, 1)}
    assert {r.f: (r.n, r.d) for r in run()} == {"sh600000": (35, 35), "sz000001": (10, 10), "bj830001": (1, 1)}
