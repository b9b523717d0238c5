"""Source, sink, join and set queries."""

from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import joins as J
from tidemark.operators import screens as S
from tidemark.plans import views as V
from tidemark.plans.catalog import query
from tidemark.plans.queries_flow import free_shares, rounded
from tidemark.plans.queries_screens import K, T, YEARS
from tidemark.session import stage, work_dir
from tidemark.sinks import tables as W
from tidemark.sources import market as M


def l2_deals(spark, d):
    """The deal view written and read back as a level-2 table, partitioned by day."""
    deals = V.deals(spark, d)
    full = deals.select(*[
        (F.col(f.name) if f.name in deals.columns else F.lit(0)).cast(f.dataType).alias(f.name) for f in schemas.DEAL.fields])
    path = work_dir(spark, "l2-deal")
    full.write.partitionBy("TradingDay").parquet(path)
    return path


L2 = "SecuCode::INTEGER AS SecuCode, TradingDay::INTEGER AS TradingDay, DealID, DealTime::INTEGER AS DealTime, Price::INTEGER AS Price, Volume, Side::INTEGER AS Side, BuyID, SellID"
L2_COLS = ["SecuCode", "TradingDay", "DealID", "DealTime", "Price", "Volume", "Side", "BuyID", "SellID"]


@query("src01_l2_scan", f"SELECT {L2}, 0::INTEGER AS BizIndex, 0::INTEGER AS Channel FROM deals")
def _(spark, d):
    return M.read_l2(spark, "deal", l2_deals(spark, d))


@query("src02_pruned_scan", "SELECT DealID, Price::INTEGER AS Price, Volume FROM deals")
def _(spark, d):
    return M.read_l2(spark, "deal", l2_deals(spark, d), columns=["DealID", "Price", "Volume"])


@query("src03_stock_list_scan", f"SELECT {L2} FROM deals WHERE SecuCode IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def _(spark, d):
    stocks = V.table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").cast("int").alias("SecuCode"))
    return M.read_l2(spark, "deal", l2_deals(spark, d), stocks=stocks, columns=L2_COLS)


@query("src04_day_scan", f"SELECT {L2} FROM deals WHERE TradingDay = 1998")
def _(spark, d):
    return M.read_l2(spark, "deal", l2_deals(spark, d), day=1998, columns=L2_COLS)


@query("src05_daily_csv", "SELECT symbol::VARCHAR AS symbol, t, open, high, low, close, volume FROM bars_m WHERE t > 23960")
def _(spark, d):
    path = work_dir(spark, "bars-csv")
    V.bars_m(spark, d).select("symbol", "t", "open", "high", "low", "close", "volume").repartition("symbol").write.partitionBy("symbol").csv(
        path, header=True)  # one file a symbol, not one for each task that has rows of it
    return M.read_daily_csv(
        spark, path, "t int, open bigint, high bigint, low bigint, close bigint, volume bigint", F.lit(23960),
        symbol=r"symbol=([^/]+)/")


@query("src06_all_symbols", "SELECT symbol, t, close FROM bars_m")
def _(spark, d):
    return stage(V.bars_m(spark, d)).select("symbol", "t", "close")


@query("src07_universe", "SELECT c_custkey AS ticker FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def _(spark, d):
    listed = V.table(spark, d, "customer").select(F.col("c_custkey").alias("ticker"))
    out = V.table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("ticker"))
    return M.universe(listed, out)


@query("src08_statements", "SELECT s_name AS Ticker, s_nationkey AS Nation, s_acctbal AS Balance FROM supplier WHERE s_name LIKE '%7'")
def _(spark, d):
    path = work_dir(spark, "statement")
    V.table(spark, d, "supplier").select("s_name", "s_nationkey", "s_acctbal").write.option("sep", ";").csv(path, header=True)
    return M.read_statement(spark, path, "Ticker string, Nation int, Balance double").where(F.col("Ticker").endswith("7"))


@query("src09_float_shares", """
SELECT SecuCode, TradingDay, Volume, coalesce(CASE WHEN s_acctbal > 0 THEN s_suppkey * 1000 END, 10000000) AS free_shares
FROM (SELECT SecuCode, TradingDay, sum(Volume)::BIGINT AS Volume FROM deals GROUP BY 1, 2) LEFT JOIN supplier ON SecuCode = s_suppkey""")
def _(spark, d):
    days = V.deals(spark, d).groupBy("SecuCode", "TradingDay").agg(F.sum("Volume").alias("Volume"))
    meta = V.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("SecuCode"), F.when(F.col("s_acctbal") > 0, F.col("s_suppkey") * 1000).alias("ActiveCapital"))
    return M.with_float_shares(days, meta)


@query("src10_trading_dates", "SELECT DISTINCT strftime(o_orderdate, '%Y%m%d') AS day FROM orders WHERE strftime(o_orderdate, '%Y%m') = '199703'")
def _(spark, d):
    day = F.date_format("o_orderdate", "yyyyMMdd")
    years = V.table(spark, d, "orders").select(day.alias("day")).distinct().groupBy(F.substring("day", 1, 4).alias("y")).agg(
        F.sort_array(F.collect_list("day")).alias("days"))  # at most 366 days a year
    calendar = years.select(F.to_json(F.create_map("y", "days")).alias("json"))
    return M.trading_dates(calendar, "json", F.lit("199703"))


@query("src16_manifest", "SELECT s_name || '.zip' AS filename, md5(s_name) AS hash, s_suppkey * 10 AS filesize FROM supplier")
def _(spark, d):
    path = work_dir(spark, "manifest")
    V.table(spark, d, "supplier").select(F.concat("s_name", F.lit(".zip")), F.md5("s_name"), F.col("s_suppkey") * 10).write.csv(path)
    return M.read_manifest(spark, path)


@query("src17_info_map", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def _(spark, d):
    rows = M.map_columns(V.table(spark, d, "events").select("event_id", "props"), "props", {"k": "bigint"})
    return rows.select("event_id", "k")


@M.register_feed("tables")
class TableFeed(M.Feed):
    """Bars and members out of the given tables."""

    def daily(self, spark, path):
        return V.bars_m(spark, path)

    def members(self, spark, path):
        return V.sectors(spark, path)


@query("src18_feed", "SELECT symbol, t, close, sector FROM bars_m JOIN sectors USING (symbol)")
def _(spark, d):
    source = M.feed("tables")
    return source.daily(spark, d).join(source.members(spark, d), "symbol").select("symbol", "t", "close", "sector")


@query("src19_fields_to_bars", """
SELECT t AS date, symbol::VARCHAR AS symbol, open::DOUBLE AS open, high::DOUBLE AS high, low::DOUBLE AS low, close::DOUBLE AS close, volume::DOUBLE AS volume FROM bars_m""")
def _(spark, d):
    names = ["open", "high", "low", "close", "volume"]
    cells = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("v")) for n in names])
    # One JSON map per (field, date, block of symbols): a map holds a hundred symbols at most.
    long = V.bars_m(spark, d).select("symbol", F.col("t").alias("date"), F.explode(cells).alias("c"))
    landed = long.groupBy("c.field", "date", F.expr("symbol div 100").alias("block")).agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("symbol").cast("string"), F.col("c.v"))))).alias("values"))
    return M.fields_to_bars(landed)


@query("src19_order_analysis", """
SELECT symbol::VARCHAR AS symbol, t::VARCHAR AS date, """ + ", ".join(
    f"(volume + {i})::DOUBLE AS {c.lower()}" for i, c in enumerate(M.ORDER_ANALYSIS)) + " FROM bars_m")
def _(spark, d):
    item = lambda i: F.struct(F.col("t").cast("string").alias("Date"), (F.col("volume") + i).cast("double").alias("Value"))
    lists = V.bars_m(spark, d).groupBy("symbol", F.expr("t div 12")).agg(  # at most twelve months a list
        *[F.sort_array(F.collect_list(item(i))).alias(c) for i, c in enumerate(M.ORDER_ANALYSIS)])
    reply = F.to_json(F.struct(F.lit("0").alias("ErrorId"), *M.ORDER_ANALYSIS))
    return M.order_analysis_rows(lists.select(F.col("symbol").cast("string").alias("symbol"), reply.alias("reply")))


def _old_new(spark, d):
    bars = V.bars_m(spark, d).select("symbol", "t", "close")
    new = bars.where("t >= 24000").withColumn("close", F.col("close") + 1)
    return bars.where("t < 24010"), new


@query("snk04_upsert", """
SELECT symbol, t, close FROM bars_m WHERE t < 24010 AND t NOT IN (SELECT t FROM bars_m WHERE t >= 24000)
UNION ALL SELECT symbol, t, close + 1 FROM bars_m WHERE t >= 24000""")
def _(spark, d):
    old, new = _old_new(spark, d)
    return W.upserted(old, new, ["t"]).orderBy("symbol", "t")


@query("snk04_dynamic_overwrite", """
SELECT symbol, t::INTEGER AS t, close FROM bars_m WHERE t < 24000 UNION ALL SELECT symbol, t::INTEGER, close + 1 FROM bars_m WHERE t >= 24000""")
def _(spark, d):
    old, new = _old_new(spark, d)
    path = work_dir(spark, "upsert")
    W.upsert_partitions(old, path, "t")
    W.upsert_partitions(new, path, "t")
    return spark.read.schema("symbol bigint, close bigint, t int").parquet(path)


@query("snk05_append_newer", """
WITH s AS (SELECT symbol, max(t) AS last FROM bars_m WHERE t < 23990 + symbol AND symbol % 5 > 0 GROUP BY 1)
SELECT symbol, t, close FROM bars_m LEFT JOIN s USING (symbol) WHERE last IS NULL OR t > last""")
def _(spark, d):
    bars = V.bars_m(spark, d).select("symbol", "t", "close")
    return W.newer_rows(bars.where("t < 23990 + symbol and symbol % 5 > 0"), bars, K, "t")


@query("snk05_append_twice", "SELECT symbol, t, close FROM bars_m")
def _(spark, d):
    bars, path = V.bars_m(spark, d).select("symbol", "t", "close"), work_dir(spark, "appended")
    first = bars.where("t < 23990 + symbol and symbol % 5 > 0")
    for rows in (first, bars, bars):  # the last run finds everything stored
        ledger = W.append_newer(rows, path, K, "t")
    return ledger.rows()


@query("snk09_short_tables", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) < 8")
def _(spark, d):
    return W.short_tables(V.table(spark, d, "orders"), "o_custkey", 8)


@query("snk01_split_by_stock", "SELECT SecuCode::INTEGER AS SecuCode, TradingDay::INTEGER AS TradingDay, DealID, Price FROM deals")
def _(spark, d):
    path = work_dir(spark, "split")
    W.write_by_stock(V.deals(spark, d).withColumn("SecuCode", F.col("SecuCode").cast("int")).select("SecuCode", "TradingDay", "DealID", "Price"), path)
    return spark.read.schema("SecuCode int, DealID bigint, Price bigint, TradingDay int").parquet(path)


@query("snk02_staged_sorted", "SELECT SecuCode::INTEGER AS SecuCode, TradingDay::INTEGER AS TradingDay, DealID, DealTime FROM deals")
def _(spark, d):
    path = work_dir(spark, "sorted")
    W.write_staged(V.deals(spark, d).withColumn("SecuCode", F.col("SecuCode").cast("int")).select("SecuCode", "TradingDay", "DealID", "DealTime"), path, "DealTime", "DealID")
    return spark.read.schema("SecuCode int, DealID bigint, DealTime bigint, TradingDay int").parquet(path)


@query("snk03_compaction", "SELECT SecuCode, TradingDay, DealID, DealTime FROM deals")
def _(spark, d):
    path = work_dir(spark, "compact")
    W.compact(V.deals(spark, d).select("SecuCode", "TradingDay", "DealID", "DealTime"), path, "deal")
    return spark.read.parquet(path)


@query("snk06_report", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def _(spark, d):
    path = work_dir(spark, "report")
    rows = V.table(spark, d, "customer").join(V.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    W.write_report(rows.groupBy("n_name").agg(F.count("*").alias("n")), path, ["n_name", "n"])
    return spark.read.schema("n_name string, n bigint").option("header", True).csv(path)


@query("snk07_per_date", "SELECT symbol, close, t::INTEGER AS t FROM bars_m")
def _(spark, d):
    path = work_dir(spark, "per-date")
    W.write_per_date(V.bars_m(spark, d).select("symbol", "close", "t"), path, "t")
    return spark.read.schema("symbol bigint, close bigint, t int").option("header", True).csv(path)


@query("snk08_chunked_csv", "SELECT o_orderkey, o_custkey FROM orders")
def _(spark, d):
    path = work_dir(spark, "chunks")
    W.write_chunks(V.table(spark, d, "orders").select("o_orderkey", "o_custkey"), path, 1000)
    return spark.read.schema("o_orderkey bigint, o_custkey bigint").option("header", True).csv(path)


@query("jn10_code_names", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _(spark, d):
    names = V.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return V.table(spark, d, "orders").join(names, "o_custkey", "left").select("o_orderkey", "c_name")


V.VIEW_SQL["reports"] = "SELECT symbol, t, close AS assets, volume AS shares FROM bars_m WHERE t % 3 = 0"


def reports(spark, d):
    return V.bars_m(spark, d).where("t % 3 = 0").select("symbol", "t", F.col("close").alias("assets"), F.col("volume").alias("shares"))


@query("jn11_next_report", """
SELECT b.symbol, b.t, arg_min(r.t, r.t) AS report_t, arg_min(r.assets, r.t) AS assets FROM bars_m b LEFT JOIN reports r ON r.symbol = b.symbol AND r.t > b.t GROUP BY 1, 2""")
def _(spark, d):
    out = J.as_of(V.bars_m(spark, d).select("symbol", "t"), reports(spark, d), K, "t", "rep", YEARS, "forward", False)
    return out.select("symbol", "t", F.col("rep.t").alias("report_t"), F.col("rep.assets").alias("assets"))


@query("jn11_previous_report", """
SELECT b.symbol, b.t, r.t AS report_t, r.assets FROM bars_m b ASOF LEFT JOIN reports r ON r.symbol = b.symbol AND r.t <= b.t""")
def _(spark, d):
    out = J.as_of(V.bars_m(spark, d).select("symbol", "t"), reports(spark, d), K, "t", "rep", YEARS)
    return out.select("symbol", "t", F.col("rep.t").alias("report_t"), F.col("rep.assets").alias("assets"))


@query("wn34_ncav", """
WITH a AS (SELECT b.symbol, b.t, b.close, arg_min(r.assets, r.t) AS assets, arg_min(r.shares, r.t) AS shares
  FROM bars_m b JOIN reports r ON r.symbol = b.symbol AND r.t > b.t GROUP BY ALL),
f AS (SELECT symbol, t, (assets / 10000 - 300) / shares AS ncav FROM a WHERE (assets / 10000 - 300) / shares > 1.5)
SELECT symbol, t, round(ncav, 3) AS ncav, round(1.0 / count(*) OVER (PARTITION BY t), 6) AS weight FROM f""")
def _(spark, d):
    out = J.as_of(V.bars_m(spark, d).select("symbol", "t"), reports(spark, d), K, "t", "rep", YEARS, "forward", False)
    value = (F.col("rep.assets") / 10000 - 300) / F.col("rep.shares")
    cheap = stage(out.select("symbol", "t", value.alias("ncav")).where("ncav > 1.5"))
    return S.equal_weights(cheap, "t").select(
        "symbol", "t", F.round("ncav", 3).alias("ncav"), F.round("weight", 6).alias("weight"))


@query("jn12_calendar_roll", """
WITH c AS (SELECT DISTINCT date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS day FROM orders WHERE o_orderstatus = 'F'),
l AS (SELECT DISTINCT date_diff('day', DATE '1990-01-01', l_shipdate::DATE) AS day FROM lineitem)
SELECT l.day::INTEGER AS day, (SELECT min(c.day) FROM c WHERE c.day >= l.day)::INTEGER AS next_day, (SELECT max(c.day) FROM c WHERE c.day <= l.day)::INTEGER AS previous_day FROM l""")
def _(spark, d):
    day = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1990-01-01").cast("date")).alias("day")
    calendar = V.table(spark, d, "orders").where("o_orderstatus = 'F'").select(day("o_orderdate"))
    days = V.table(spark, d, "lineitem").select(day("l_shipdate")).distinct()
    ahead = J.roll_calendar(days, calendar, "day", True).withColumnRenamed("trading_day", "next_day")
    return ahead.join(J.roll_calendar(days, calendar, "day", False).withColumnRenamed("trading_day", "previous_day"), "day")


@query("jn14_stock_list", "SELECT symbol, t, close FROM bars_m SEMI JOIN (SELECT s_suppkey AS symbol FROM supplier WHERE s_acctbal < 0) USING (symbol)")
def _(spark, d):
    stocks = V.table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("symbol"))
    return V.bars_m(spark, d).join(stocks, "symbol", "left_semi").select("symbol", "t", "close")


@query("jn15_pair_alignment", """
SELECT a.symbol AS a, b.symbol AS b, t, a.close AS value_a, b.close AS value_b FROM bars_m a JOIN bars_m b USING (t) WHERE b.symbol = a.symbol + 1""")
def _(spark, d):
    bars = V.bars_m(spark, d)
    pairs = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 1).alias("b"))
    return J.pair_alignment(bars, "symbol", "t", "close", pairs)


@query("jn18_all_statements", """
SELECT c_custkey, c_acctbal, n, spent FROM customer JOIN (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders GROUP BY 1) USING (c_custkey)
JOIN (SELECT o_custkey AS c_custkey, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS spent FROM orders GROUP BY 1) USING (c_custkey)""")
def _(spark, d):
    orders = V.table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    counts = orders.groupBy("c_custkey").agg(F.count("*").alias("n"))
    spent = orders.groupBy("c_custkey").agg(F.sum(V.cents("o_totalprice")).alias("spent"))
    return V.table(spark, d, "customer").select("c_custkey", "c_acctbal").join(counts, "c_custkey").join(spent, "c_custkey")


@query("jn19_sector_members", """
WITH b AS (SELECT sector, symbol FROM sectors UNION ALL SELECT 'theme' || theme, symbol FROM sectors),
m AS (SELECT b.* FROM b JOIN (SELECT sector FROM b GROUP BY 1 HAVING count(*) >= 6) USING (sector))
SELECT symbol, min(sector) AS sector FROM m GROUP BY 1""")
def _(spark, d):
    s = V.sectors(spark, d)
    bridge = s.select("sector", "symbol").unionByName(
        s.select(F.concat(F.lit("theme"), F.col("theme")).alias("sector"), "symbol"))
    return J.keep_first(J.sector_members(bridge, 6), "symbol", F.col("sector"))


@query("tk01_stable_sort", "SELECT SecuCode, TradingDay, DealTime, DealID, Price FROM deals ORDER BY TradingDay, DealTime, DealID, Price, SecuCode")
def _(spark, d):
    return V.deals(spark, d).select("SecuCode", "TradingDay", "DealTime", "DealID", "Price").orderBy(
        "TradingDay", "DealTime", "DealID", "Price", "SecuCode")


@query("tk06_order_by_two_keys", "SELECT symbol, t, round(r2, 6) AS r2, round(momentum, 6) AS momentum FROM quality_m WHERE r2 > 0.2")
def _(spark, d):
    from tidemark.plans.queries_screens import stocks
    s = S.momentum_quality(stocks(spark, d, 24), 24, {20: 0.7, 24: 0.3})
    rows = rounded(s.close().where("r2 > 0.2").select("symbol", "t", "r2", "momentum"))
    return rows.orderBy(F.desc("r2"), F.desc("momentum"), "symbol", "t")


@query("so01_concat", "SELECT symbol, t, close FROM bars_m WHERE t < 24000 UNION ALL SELECT symbol, t, close FROM bars_m WHERE t >= 23990")
def _(spark, d):
    bars = V.bars_m(spark, d).select("symbol", "t", "close")
    return bars.where("t < 24000").unionByName(bars.where("t >= 23990"))


def _codes(spark, d, status):
    return V.table(spark, d, "orders").where(F.col("o_orderstatus") == status).select("o_custkey")


def _codes_sql(op):
    return f"SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' {op} SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'"


@query("so02_intersection", _codes_sql("INTERSECT"))
def _(spark, d):
    return _codes(spark, d, "O").intersect(_codes(spark, d, "P"))


@query("so03_difference", _codes_sql("EXCEPT"))
def _(spark, d):
    return _codes(spark, d, "O").distinct().join(_codes(spark, d, "P"), "o_custkey", "left_anti")


@query("so04_keep_first", """
SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders GROUP BY 1""")
def _(spark, d):
    rows = V.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return J.keep_first(rows, "o_custkey", F.col("o_orderdate"), F.col("o_orderkey")).drop("o_orderdate")


@query("so05_distinct", "SELECT DISTINCT SecuCode, TradingDay FROM deals")
def _(spark, d):
    return V.deals(spark, d).select("SecuCode", "TradingDay").distinct()


@query("so06_filter_union", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000 OR o_orderpriority = '1-URGENT'")
def _(spark, d):
    return V.table(spark, d, "orders").where("o_totalprice > 300000 or o_orderpriority = '1-URGENT'").select("o_orderkey", "o_totalprice")


@query("so07_paged_history", "SELECT symbol, t, close FROM bars_m WHERE t BETWEEN 23960 AND 24000")
def _(spark, d):
    bars = V.bars_m(spark, d).select("symbol", "t", "close")
    pages = bars.where("t < 23985").unionByName(bars.where("t >= 23980"))
    return pages.dropDuplicates(["symbol", "t"]).where("t between 23960 and 24000")
