"""Binary and text readers on files written byte by byte."""

import math
import struct

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.operators import risk as R
from tidemark.sinks import tables as W
from tidemark.sources import fixed_width as X
from tidemark.sources import market as M


def test_daily_bars(spark, tmp_path):
    rec = struct.pack("<IIIIIfII", 20240102, 1010, 1050, 1000, 1020, 12345.5, 700, 0)
    (tmp_path / "sh600000.day").write_bytes(rec * 2)
    (tmp_path / "sz150001.day").write_bytes(rec)
    rows = X.read_daily(spark, str(tmp_path)).orderBy("symbol").collect()
    assert [(r.symbol, r.kind) for r in rows] == [("sh600000", "SH_A_STOCK")] * 2 + [("sz150001", "SZ_FUND")]
    a, f = rows[0], rows[2]
    assert (str(a.date), round(a.open, 4), round(a.close, 4), a.amount, round(a.volume, 4)) == ("2024-01-02", 10.1, 10.2, 12345.5, 7.0)
    assert round(f.high, 4) == 1.05


def test_daily_bars_of_an_unknown_exchange_stay(spark, tmp_path):
    rec = struct.pack("<IIIIIfII", 20240102, 1010, 1050, 1000, 1020, 12345.5, 700, 0)
    for name in ("xx600000.day", "other.day", "sh600000.day"):
        (tmp_path / name).write_bytes(rec)
    got = {r.symbol: (r.kind, r.open is None, r.amount) for r in X.read_daily(spark, str(tmp_path)).collect()}
    assert got == {"xx600000": (None, True, 12345.5), "other": (None, True, 12345.5), "sh600000": ("SH_A_STOCK", False, 12345.5)}


def test_minute_bars(spark, tmp_path):
    day = (2024 - 2004) * 2048 + 102
    (tmp_path / "sz000001.lc5").write_bytes(struct.pack("<HHfffffII", day, 9 * 60 + 35, 1.5, 2.5, 1.0, 2.0, 9.0, 33, 0))
    r = X.read_minute(spark, str(tmp_path), glob="*.lc5").first()
    assert (r.symbol, str(r.time), r.open, r.close, r.volume) == ("sz000001", "2024-01-02 09:35:00", 1.5, 2.0, 33)
    (tmp_path / "sz000002.5").write_bytes(struct.pack("<HHIIIIfII", day, 570, 150, 250, 100, 200, 9.0, 33, 0))
    r = X.read_minute(spark, str(tmp_path), "int", "*.5").first()
    assert (r.open, r.high, r.low, r.close) == (1.5, 2.5, 1.0, 2.0)


def test_futures(spark, tmp_path):
    bits = struct.unpack("<I", struct.pack("<f", 3.25))[0]
    (tmp_path / "IF.day").write_bytes(struct.pack("<IffffIIf", 20240102, 1.0, 2.0, 0.5, 1.5, bits, 8, 1.25))
    r = X.read_futures(spark, str(tmp_path)).first()
    assert (str(r.date), r.high, r.amount, r.volume, r.settle, r.stock_amount) == ("2024-01-02", 2.0, bits, 8, 1.25, 3.25)


def test_blocks(spark, tmp_path):
    def block(name, kind, codes):
        body = b"".join(c.encode().ljust(7, b"\0") for c in codes).ljust(2800, b"\0")
        return name.encode("gbk").ljust(9, b"\0") + struct.pack("<HH", len(codes), kind) + body
    data = b"\0" * 384 + struct.pack("<H", 2) + block("银行", 2, ["600000", "000001"]) + block("B", 1, ["300001"])
    (tmp_path / "block.dat").write_bytes(data)
    flat = X.read_blocks(spark, str(tmp_path))
    assert [tuple(r) for r in flat.orderBy("blockname", "code_index").collect()] == [
        ("B", 1, 0, "300001"), ("银行", 2, 0, "600000"), ("银行", 2, 1, "000001")]
    grouped = {r.blockname: (r.stock_count, r.code_list) for r in X.grouped_blocks(flat).collect()}
    assert grouped == {"银行": (2, "600000,000001"), "B": (1, "300001")}


def test_custom_blocks(spark, tmp_path):
    (tmp_path / "blocknew.cfg").write_bytes("自选".encode("gbk").ljust(50, b"\0") + b"ZX".ljust(70, b"\0"))
    (tmp_path / "ZX.blk").write_text("1600000\n\n0000001\n")
    rows = X.read_custom_blocks(spark, str(tmp_path)).orderBy("code_index").collect()
    assert [tuple(r) for r in rows] == [("自选", "ZX", 0, "600000"), ("自选", "ZX", 2, "000001")]


def test_reports(spark, tmp_path):
    head = struct.pack("<hIH3L", 1, 20240331, 2, 0, 8, 0) if struct.calcsize("<hIH3L") == X.REPORT_HEADER.itemsize else b""
    offset = len(head) + 2 * 11
    index = struct.pack("<6s1cL", b"600000", b"0", offset) + struct.pack("<6s1cL", b"000001", b"0", offset + 8)
    (tmp_path / "gp.dat").write_bytes(head + index + struct.pack("<4f", 1.0, 2.0, 3.0, 4.0))
    reports = X.read_reports(spark, str(tmp_path))
    named = X.report_columns(reports, ["eps", "bps"]).orderBy("code").collect()
    assert [tuple(r) for r in named] == [("000001", 20240331, 3.0, 4.0), ("600000", 20240331, 1.0, 2.0)]


def test_daily_csv_start_rules(spark, tmp_path):
    (tmp_path / "600000.csv").write_text("date,open,high,low,close,volume\n2024-01-02,1,2,1,2,10\n2024-01-03,2,3,2,3,20\n")
    start = F.lit("2024-01-02").cast("date")
    strict = M.read_daily_csv(spark, str(tmp_path), start=start)
    loose = M.read_daily_csv(spark, str(tmp_path), start=start, strict=False)
    assert [(r.symbol, str(r.date)) for r in strict.collect()] == [("600000", "2024-01-03")]
    assert loose.count() == 2


def test_pushdown_of_day_and_columns(spark, tmp_path):
    path = str(tmp_path / "deal")
    spark.range(10).select(*[F.lit(1).cast(f.dataType).alias(f.name) for f in M.schemas.DEAL.fields]).write.parquet(path)
    df = M.read_l2(spark, "deal", path, day=1, columns=["Price", "Volume"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(TradingDay,1)" in plan and "DealID" not in plan


def test_vendor_errors_are_dropped(spark):
    item = '[{"Date":"20240102","Value":1.5}]'
    good = '{"ErrorId":"0",' + ",".join(f'"{c}":{item}' for c in M.ORDER_ANALYSIS) + "}"
    df = spark.createDataFrame([("a", good), ("b", '{"ErrorId":"7"}')], "symbol string, reply string")
    rows = M.order_analysis_rows(df).collect()
    assert len(rows) == 1 and rows[0].symbol == "a" and rows[0].small_market == 1.5


def test_compacted_files_are_sorted_zstd_with_bounded_row_groups(spark, tmp_path):
    rows = spark.range(3000).selectExpr("id % 3 as SecuCode", "20240102 as TradingDay", "5000 - id as DealID")
    W.compact(rows, str(tmp_path / "t"), "deal")
    files = [pq.ParquetFile(f) for f in sorted((tmp_path / "t").glob("*.parquet"))]
    assert sum(f.metadata.num_rows for f in files) == 3000
    for f in files:
        groups = [f.metadata.row_group(i) for i in range(f.num_row_groups)]
        assert all(g.num_rows <= W.ROW_GROUP_ROWS and g.column(0).compression == "ZSTD" for g in groups)
        got = f.read().to_pylist()
        keys = [(r["SecuCode"], r["TradingDay"], r["DealID"]) for r in got]
        assert keys == sorted(keys)


def test_row_groups_end_at_the_row_limit(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "ROW_GROUP_ROWS", 500)
    W.compact(spark.range(0, 4000, 1, 1).selectExpr("1 as SecuCode", "20240102 as TradingDay", "id as DealID"), str(tmp_path / "t"), "deal")
    sizes = [f.metadata.row_group(i).num_rows for f in map(pq.ParquetFile, (tmp_path / "t").glob("*.parquet")) for i in range(f.num_row_groups)]
    assert max(sizes) <= 500 and sum(sizes) == 4000


def test_staged_files_keep_the_time_order_of_each_stock_day(spark, tmp_path):
    rows = spark.range(2000).selectExpr("id % 4 as SecuCode", "20240102 + id % 2 as TradingDay", "9999 - id as DealTime", "id as DealID")
    W.write_staged(rows, str(tmp_path / "t"), "DealTime", "DealID")
    files = sorted((tmp_path / "t").glob("TradingDay=*/*.parquet"))
    assert {f.parent.name for f in files} == {"TradingDay=20240102", "TradingDay=20240103"}
    total = 0
    for f in map(pq.ParquetFile, files):
        keys = [(r["SecuCode"], r["DealTime"], r["DealID"]) for r in f.read().to_pylist()]
        total += len(keys)
        assert keys == sorted(keys) and f.metadata.row_group(0).column(0).compression == "ZSTD"
    assert total == 2000


def test_split_files_hold_whole_sorted_stocks(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id % 5 as SecuCode", "20240102 as TradingDay", "id as DealID", "7 as Price")
    W.write_by_stock(rows, str(tmp_path / "t"))
    files = list((tmp_path / "t").glob("TradingDay=20240102/*.parquet"))
    codes = [pq.ParquetFile(f).read().column("SecuCode").to_pylist() for f in files]
    assert sum(map(len, codes)) == 1000 and all(c == sorted(c) for c in codes)


def test_a_failed_split_leaves_no_data_to_read(spark, tmp_path):
    rows = spark.range(10).selectExpr("id as SecuCode", "20240102 as TradingDay", "if(id = 7, raise_error('bad row'), id) as DealID", "7 as Price")
    with pytest.raises(Exception, match="bad row"):
        W.write_by_stock(rows, str(tmp_path / "t"))
    assert not list((tmp_path / "t").glob("TradingDay=*/*.parquet")) and not (tmp_path / "t" / "_SUCCESS").exists()


def test_a_second_append_adds_nothing(spark, tmp_path):
    path, kind = str(tmp_path / "t"), "k int, t int"
    W.append_newer(spark.createDataFrame([(1, 10), (2, 20)], kind), path, ["k"], "t")
    new = spark.createDataFrame([(1, 10), (1, 11), (2, 19), (3, 1), (3, 2)], kind)
    for _ in range(2):
        ledger = W.append_newer(new, path, ["k"], "t")
    assert sorted(map(tuple, ledger.rows().collect())) == [(1, 10), (1, 11), (2, 20), (3, 1), (3, 2)]
    assert sorted(map(tuple, ledger.last().collect())) == [(1, 11), (2, 20), (3, 2)]


def test_an_append_that_is_not_committed_changes_nothing(spark, tmp_path, monkeypatch):
    """A crash between the rows and the commit; the same batch again; a second run that takes the same number."""
    from tidemark.sinks.ledger import Ledger

    path, schema = str(tmp_path / "t"), spark.createDataFrame([], "k int, t int").schema
    df = lambda *rows: spark.createDataFrame(rows, schema)
    table = lambda: Ledger(spark, path, schema, ["k"], "t")
    assert table().rows().collect() == [] and table().last() is None
    assert table().append(df((1, 1)), "a")
    with monkeypatch.context() as m:
        m.setattr(Ledger, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table().append(df((1, 2), (2, 1)), "b")
    assert sorted(map(tuple, table().rows().collect())) == [(1, 1)]
    assert table().append(df((1, 2), (2, 1)), "b") and not table().append(df((1, 3)), "b")
    assert sorted(map(tuple, table().rows().collect())) == [(1, 1), (1, 2), (2, 1)]
    with pytest.raises(Exception, match="(?i)exists"):
        table()._commit(1, {})


def test_an_append_reads_no_stored_rows(spark, tmp_path, monkeypatch):
    from tidemark.sinks import ledger as L

    monkeypatch.setattr(L, "SUMMARY_EVERY", 3)
    path, schema = str(tmp_path / "t"), spark.createDataFrame([], "k int, t int").schema
    for i in range(8):
        table = L.Ledger(spark, path, schema, ["k"], "t")
        assert table.append(spark.createDataFrame([(i % 2, i)], schema), f"b{i}")
        for data in (tmp_path / "t" / "data").iterdir():  # what is stored can be unreadable
            for file in data.glob("*.parquet"):
                file.rename(file.with_suffix(".kept"))
        assert not table.append(spark.createDataFrame([(0, 100)], schema), f"b{i}")
    assert len(table._commits()) <= 3
    for data in (tmp_path / "t" / "data").iterdir():
        for file in data.glob("*.kept"):
            file.rename(file.with_suffix(".parquet"))
    assert sorted(map(tuple, table.rows().collect())) == [(i % 2, i) for i in sorted(range(8), key=lambda i: (i % 2, i))]


def test_a_report_is_one_small_file_with_the_expected_columns(spark, tmp_path):
    rows = spark.range(100).selectExpr("id % 7 as k").groupBy("k").count()
    W.write_report(rows, str(tmp_path / "r"), ["k", "count"])
    assert len(list((tmp_path / "r").glob("*.csv"))) == 1
    with pytest.raises(ValueError):
        W.write_report(rows, str(tmp_path / "r2"), ["k"])


def test_normal_distribution_function_is_close_to_the_exact_one(spark):
    points = [i / 8 for i in range(-48, 49)]
    got = spark.createDataFrame([(z,) for z in points], "z double").withColumn("c", R.normal_cdf(F.col("z"))).collect()
    assert max(abs(r.c - 0.5 * math.erfc(-r.z / math.sqrt(2))) for r in got) < 1.5e-7
