"""Selection-pool queries."""

from pyspark.sql import functions as F

from tidemark.functions.series import open_series
from tidemark.operators import pool as P
from tidemark.operators import screens as S
from tidemark.plans import views as V
from tidemark.plans.catalog import query
from tidemark.plans.queries_flow import rounded
from tidemark.plans.queries_screens import IGNITE, YEARS, sector_scores, stocks
from tidemark.session import stage

TODAY = 24022
V.VIEW_SQL["pool0"] = """
SELECT c_custkey AS ts_code, c_name AS name, 23950 + c_custkey % 40 AS indate, CASE WHEN c_custkey % 2 = 0 THEN 'box' ELSE 'trend' END AS reason
FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')"""
V.VIEW_SQL["deleted0"] = "SELECT c_custkey AS ts_code, c_name AS name FROM customer WHERE c_mktsegment = 'AUTOMOBILE'"
V.VIEW_SQL["picks0"] = "SELECT DISTINCT c_custkey AS ts_code, c_name AS name FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 200000"


def pool0(spark, d):
    key = F.col("c_custkey")
    return V.table(spark, d, "customer").where("c_mktsegment in ('BUILDING', 'MACHINERY')").select(
        key.alias("ts_code"), F.col("c_name").alias("name"), (key % 40 + 23950).alias("indate"),
        F.array(F.when(key % 2 == 0, "box").otherwise("trend")).alias("in_type"))


def deleted0(spark, d):
    return V.table(spark, d, "customer").where("c_mktsegment = 'AUTOMOBILE'").select(
        F.col("c_custkey").alias("ts_code"), F.col("c_name").alias("name"))


def picks0(spark, d):
    big = V.table(spark, d, "orders").where("o_orderpriority = '1-URGENT' and o_totalprice > 200000").select(
        F.col("o_custkey").alias("c_custkey"))
    return V.table(spark, d, "customer").join(big, "c_custkey", "left_semi").select(
        F.col("c_custkey").alias("ts_code"), F.col("c_name").alias("name"))


ADD_SQL = """
SELECT ts_code, name, indate::BIGINT AS indate, CASE WHEN ts_code IN (SELECT ts_code FROM picks0) AND reason <> 'trend' THEN reason || ' | trend' ELSE reason END AS in_type FROM pool0
UNION ALL SELECT ts_code, name, 24022, CASE WHEN ts_code IN (SELECT ts_code FROM deleted0) THEN 'trend重返' ELSE 'trend' END
FROM picks0 WHERE ts_code NOT IN (SELECT ts_code FROM pool0)"""


@query("pl01_add_picks", ADD_SQL)
def _(spark, d):
    pool, _ = P.add_picks(pool0(spark, d), deleted0(spark, d), picks0(spark, d), "trend", F.lit(TODAY).cast("bigint"))
    return pool.select("ts_code", "name", "indate", P.reasons().alias("in_type"))


@query("pl01_deleted_after_picks", "SELECT ts_code, name FROM deleted0 WHERE ts_code NOT IN (SELECT ts_code FROM picks0)")
def _(spark, d):
    return P.add_picks(pool0(spark, d), deleted0(spark, d), picks0(spark, d), "trend", F.lit(TODAY).cast("bigint"))[1]


@query("pl02_sync_manual", """
SELECT ts_code, 'pool' AS place, reason AS why FROM pool0 WHERE ts_code IN (SELECT ts_code FROM picks0)
UNION ALL SELECT ts_code, 'pool', CASE WHEN ts_code IN (SELECT ts_code FROM deleted0) THEN 'manual重返' ELSE 'manual' END FROM picks0 WHERE ts_code NOT IN (SELECT ts_code FROM pool0)
UNION ALL SELECT ts_code, 'deleted', NULL FROM deleted0 WHERE ts_code NOT IN (SELECT ts_code FROM picks0)
UNION ALL SELECT ts_code, 'deleted', 'manual' FROM pool0 WHERE ts_code NOT IN (SELECT ts_code FROM picks0)""")
def _(spark, d):
    pool, deleted = P.sync_manual(pool0(spark, d), deleted0(spark, d), picks0(spark, d), F.lit(TODAY).cast("bigint"))
    return pool.select("ts_code", F.lit("pool").alias("place"), P.reasons().alias("why")).unionByName(
        deleted.select("ts_code", F.lit("deleted").alias("place"), F.col("out_type").alias("why")))


def pool_bars(spark, d):
    s = open_series(V.bars_m(spark, d), ["symbol"], ["t"], YEARS, 5)
    s = s.add(_range=F.col("high") - F.col("low"))
    return s.add(atr=s.sma("_range", 5)).close().select(
        F.col("symbol").alias("ts_code"), "t", "high", "low", "close", "atr")


V.VIEW_SQL["pool_x"] = """
SELECT p.ts_code, p.indate, b.t, b.high, b.low, b.close, b.atr, row_number() OVER (PARTITION BY p.ts_code ORDER BY b.t) AS i, count(*) OVER (PARTITION BY p.ts_code) AS n
FROM pool0 p JOIN ig b ON b.symbol = p.ts_code AND b.t >= p.indate - 2"""
V.VIEW_SQL["pool_m"] = """
WITH b AS (SELECT ts_code, max(high) AS hi, arg_max(i, (high, -i)) AS hp, arg_max(t, (high, -i)) AS ht, min(low) AS lo, arg_min(t, (low, i)) AS lt,
  arg_min(close, t) AS ref, arg_max(close, t) AS last, arg_max(atr, t) AS atr, max(n) AS n, max(high) FILTER (WHERE i > n - 10) AS hh FROM pool_x GROUP BY 1),
f AS (SELECT ts_code, min(low) AS fl, arg_min(i, (low, i)) AS fp FROM pool_x JOIN b USING (ts_code) WHERE i > hp GROUP BY 1)
SELECT ts_code, hi AS highest, ht AS highest_date, lo AS lowest, lt AS lowest_date, 100.0::DOUBLE * (hi - ref) / ref AS max_gains, 100.0::DOUBLE * (last - ref) / ref AS cur_gains,
  coalesce(100.0::DOUBLE * (hi - fl) / hi, 0) AS maxdd, coalesce(fp - hp, 0)::BIGINT AS maxdd_duration, 24022 - ht AS highest_duration, last::DOUBLE AS close,
  coalesce(CASE WHEN n >= 10 THEN round(hh - 2.5::DOUBLE * atr, 2) END, 0) AS stop FROM b LEFT JOIN f USING (ts_code)"""
COLUMNS = ["highest", "highest_date", "lowest", "lowest_date", "max_gains", "cur_gains", "maxdd", "maxdd_duration", "highest_duration"]


def metrics(spark, d):
    return P.price_metrics(pool0(spark, d), pool_bars(spark, d), "t", YEARS, F.lit(TODAY))


@query("wn40_pool_metrics", """
SELECT ts_code, name, highest, highest_date, lowest, lowest_date, round(max_gains, 4) AS max_gains, round(cur_gains, 4) AS cur_gains, round(maxdd, 4) AS maxdd,
  maxdd_duration, highest_duration, close, stop FROM pool0 LEFT JOIN pool_m USING (ts_code)""")
def _(spark, d):
    m = metrics(spark, d).select("ts_code", "name", *COLUMNS, "chandelier_loss.close", "chandelier_loss.stop")
    return m.select(*[F.round(c, 4).alias(c) if c in ("max_gains", "cur_gains", "maxdd") else F.col(c) for c in m.columns])


@query("pl03_exit_rules", """
SELECT ts_code, CASE WHEN highest_duration > 60 THEN '最高点间隔超过60天' WHEN maxdd > 99.5 THEN '从最高点回撤超过30%'
  WHEN close < stop THEN printf('吊灯止损触发(Close:%.2f < Exit:%.2f)', close, stop) END AS out_type FROM pool0 LEFT JOIN pool_m USING (ts_code)""")
def _(spark, d):
    return P.apply_exits(metrics(spark, d), 60, 99.5).select("ts_code", "out_type")


V.VIEW_SQL["ignited"] = """
SELECT DISTINCT symbol AS ts_code FROM ig
WHERE pos >= 20 AND avg_conv < 60 AND mn > 0 AND mx > 0.02 AND gain > 0.1 AND v3 > v7 * 0.8 AND rise AND close > m8"""
V.VIEW_SQL["sector_picks"] = """
SELECT symbol AS ts_code, sector AS name FROM sectors JOIN (SELECT sector FROM last_sector ORDER BY score DESC, sector LIMIT 10) USING (sector)"""
V.VIEW_SQL["pool1"] = """
SELECT ts_code, indate::BIGINT AS indate, reason AS why FROM pool0 WHERE ts_code IN (SELECT ts_code FROM picks0)
UNION ALL SELECT ts_code, 24022, CASE WHEN ts_code IN (SELECT ts_code FROM deleted0) THEN 'manual重返' ELSE 'manual' END FROM picks0 WHERE ts_code NOT IN (SELECT ts_code FROM pool0)"""
V.VIEW_SQL["deleted1"] = """
SELECT ts_code, NULL::VARCHAR AS why FROM deleted0 WHERE ts_code NOT IN (SELECT ts_code FROM picks0)
UNION ALL SELECT ts_code, 'manual' FROM pool0 WHERE ts_code NOT IN (SELECT ts_code FROM picks0)"""
for _n, _strategy, _picks in ((1, "ignition", "ignited"), (2, "sector", "sector_picks")):
    V.VIEW_SQL[f"pool{_n + 1}"] = f"""
SELECT ts_code, indate, CASE WHEN ts_code IN (SELECT ts_code FROM {_picks}) AND NOT contains(why, '{_strategy}') THEN why || ' | {_strategy}' ELSE why END AS why FROM pool{_n}
UNION ALL SELECT DISTINCT ts_code, 24022, CASE WHEN ts_code IN (SELECT ts_code FROM deleted{_n}) THEN '{_strategy}重返' ELSE '{_strategy}' END
FROM {_picks} WHERE ts_code NOT IN (SELECT ts_code FROM pool{_n})"""
    V.VIEW_SQL[f"deleted{_n + 1}"] = f"SELECT * FROM deleted{_n} WHERE ts_code NOT IN (SELECT ts_code FROM {_picks} WHERE ts_code NOT IN (SELECT ts_code FROM pool{_n}))"
V.VIEW_SQL["daily_x"] = V.VIEW_SQL["pool_x"].replace("pool0", "pool3")
V.VIEW_SQL["daily_m"] = V.VIEW_SQL["pool_m"].replace("pool_x", "daily_x")


@query("pl04_daily_job", """
WITH e AS (SELECT ts_code, why, CASE WHEN highest_duration > 60 THEN '最高点间隔超过60天' WHEN maxdd > 40 THEN '从最高点回撤超过30%'
  WHEN close < stop THEN printf('吊灯止损触发(Close:%.2f < Exit:%.2f)', close, stop) END AS gone FROM pool3 LEFT JOIN daily_m USING (ts_code))
SELECT ts_code, CASE WHEN gone IS NULL THEN 'pool' ELSE 'deleted' END AS place, coalesce(gone, why) AS why FROM e
UNION ALL SELECT ts_code, 'deleted', why FROM deleted3""")
def _(spark, d):
    bars = pool_bars(spark, d)
    lit = S.ignition(stocks(spark, d, 40), IGNITE).close().where("ignited").select(
        F.col("symbol").alias("ts_code"), F.lit("ignited").alias("name"))
    best = S.top(sector_scores(spark, d), 10, F.desc("score"), F.asc("sector")).join(V.sectors(spark, d), "sector").select(
        F.col("symbol").alias("ts_code"), F.col("sector").alias("name"))
    stay, gone = P.daily_job(
        pool0(spark, d), deleted0(spark, d), picks0(spark, d), {"ignition": lit, "sector": best}, bars, "t", YEARS,
        F.lit(TODAY).cast("bigint"))
    both = stay.select("ts_code", F.lit("pool").alias("place"), P.reasons().alias("why")).unionByName(
        gone.select("ts_code", F.lit("deleted").alias("place"), F.col("out_type").alias("why")))
    return both
