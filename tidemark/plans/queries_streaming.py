"""Streaming queries, run over the event table with the available-now trigger."""

from pyspark.sql import functions as F

from tidemark.plans import views as V
from tidemark.functions.series import running
from tidemark.plans.catalog import query
from tidemark.plans.queries_book import BOX, snapshots
from tidemark.plans.queries_flow import rounded
from tidemark.session import work_dir
from tidemark.streaming import jobs as J
from tidemark.streaming import ordered as O

DELAY = "10 minutes"
HOUR_MS = 3_600_000


def stream(spark, d, name="events"):
    schema = V.table(spark, d, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def live_ticks(spark, d):
    return stream(spark, d).select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"),
        V.cents("value").alias("price"), (F.col("user_id") % 10 + 1).alias("volume"), "user_id")


def seconds(df, *names):
    return df.withColumns({n: F.unix_seconds(n) for n in names})


V.VIEW_SQL["watermark"] = "SELECT epoch_us(max(ts)) // 1000 - 600000 AS wm FROM events"


@query("st02_live_bars", """
SELECT symbol, ((ts_us + 59999999) // 60000000) * 60 AS label, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, seq) AS close, sum(volume)::BIGINT AS volume FROM ticks GROUP BY 1, 2""")
def _(spark, d):
    return seconds(J.materialised(J.bars(live_ticks(spark, d), "symbol", "1 minute"), "update", ["symbol", "label"]), "label")


@query("st03_sliding_volume", """
SELECT symbol, s AS start, sum(volume)::BIGINT AS volume, count(*) AS n, round(sum(volume) / count(*), 6) AS mean_volume
FROM (SELECT symbol, volume, unnest(range((ts_us // 1000000) // 60 * 60 - 240, (ts_us // 1000000) // 60 * 60 + 1, 60)) AS s FROM ticks) GROUP BY 1, 2""")
def _(spark, d):
    out = J.sliding(live_ticks(spark, d), "symbol", "5 minutes", "1 minute")
    out = seconds(J.materialised(out, "update", ["symbol", "start"]), "start")
    return out.withColumn("mean_volume", F.round("mean_volume", 6))


@query("st04_sessions", """
WITH a AS (SELECT user_id, ts_us, volume, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY user_id ORDER BY ts_us) < 3600000000 THEN 0 ELSE 1 END AS f FROM ticks),
b AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts_us ROWS UNBOUNDED PRECEDING) AS g FROM a)
SELECT user_id, min(ts_us) AS start_us, count(*) AS n, sum(volume)::BIGINT AS volume FROM b, watermark GROUP BY user_id, g, wm
HAVING max(ts_us) + 3600000000 <= wm * 1000""")
def _(spark, d):
    out = J.materialised(J.sessions(live_ticks(spark, d), "user_id", "1 hour"), "append")
    return out.select("user_id", F.unix_micros("start").alias("start_us"), "n", "volume")


@query("st04_phases", """
SELECT p AS phase, count(*) AS n FROM (SELECT CASE WHEN c < 91500000 THEN 'closed' WHEN c < 93000000 THEN 'opening_call' WHEN c < 113000000 THEN 'morning'
  WHEN c < 130000000 THEN 'lunch' WHEN c < 145700000 THEN 'afternoon' WHEN c < 150000000 THEN 'closing_call' ELSE 'closed' END AS p
  FROM (SELECT DealTime AS c FROM deals)) GROUP BY 1""")
def _(spark, d):
    return V.deals(spark, d).groupBy(J.trading_phase(F.col("DealTime")).alias("phase")).agg(F.count("*").alias("n"))


@query("st06_next_trade", """
WITH s AS (SELECT symbol, seq, ts_us, CASE user_id % 5 WHEN 0 THEN -1 WHEN 1 THEN -11 ELSE user_id % 2 END AS side FROM ticks),
n AS (SELECT symbol, seq, first_value(CASE WHEN side >= 0 THEN ts_us END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts_us ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_time FROM s)
SELECT symbol, seq, next_time FROM n, watermark WHERE next_time // 1000 <= wm""")
def _(spark, d):
    u = F.col("user_id")
    rows = live_ticks(spark, d).select(
        "symbol", "ts", F.unix_millis("ts").alias("at_ms"), F.unix_micros("ts").alias("clock"), "seq",
        F.when(u % 5 == 0, -1).when(u % 5 == 1, -11).otherwise(u % 2).cast("bigint").alias("side"))
    return J.materialised(O.next_trade(rows, ["symbol"], DELAY), "append").select("symbol", "seq", "next_time")


@query("st06_day_close", """
WITH s AS (SELECT symbol, seq, ts_us, ts_us // 86400000000 AS day, CASE user_id % 5 WHEN 0 THEN -1 WHEN 1 THEN -11 ELSE user_id % 2 END AS side FROM ticks),
n AS (SELECT symbol, seq, day, first_value(CASE WHEN side >= 0 THEN ts_us END IGNORE NULLS) OVER (PARTITION BY symbol, day ORDER BY ts_us, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_time FROM s)
SELECT symbol, day, seq, coalesce(next_time, 153000000) AS next_time FROM n, watermark
WHERE CASE WHEN next_time IS NULL THEN (day + 1) * 86400000 ELSE next_time // 1000 END <= wm""")
def _(spark, d):
    u = F.col("user_id")
    rows = live_ticks(spark, d).select(
        "symbol", F.expr("unix_micros(ts) div 86400000000").alias("day"), "ts", F.unix_millis("ts").alias("at_ms"),
        F.unix_micros("ts").alias("clock"), "seq",
        F.when(u % 5 == 0, -1).when(u % 5 == 1, -11).otherwise(u % 2).cast("bigint").alias("side"))
    out = O.next_trade(rows, ["symbol", "day"], DELAY, lambda key: (int(key[1]) + 1) * 86_400_000)
    return J.materialised(out, "append").select("symbol", "day", "seq", "next_time")


@query("st01_live_timeline", """
SELECT user_id, at_ms, seq, prio, kind, event_no FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY at_ms, prio, seq) AS event_no
  FROM (SELECT user_id, epoch_us(ts) // 1000 AS at_ms, event_id AS seq, event_id % 3 AS prio, event_type AS kind FROM events)), watermark WHERE at_ms <= wm""")
def _(spark, d):
    rows = stream(spark, d).select(
        "user_id", F.col("ts").cast("timestamp").alias("ts"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"),
        F.col("event_id").alias("seq"), (F.col("event_id") % 3).alias("prio"), F.col("event_type").alias("kind"))
    return J.materialised(O.timeline(rows, ["user_id"], DELAY), "append").select("user_id", "at_ms", "seq", "prio", "kind", "event_no")


V.VIEW_SQL["feed_rows"] = """
SELECT SecuCode, TradingDay, CASE kind WHEN 'insert' THEN seq ELSE seq + order_id % 3 END + 1 AS second, order_id AS seq,
  CASE kind WHEN 'insert' THEN 0 WHEN 'trade' THEN 1 ELSE 2 END AS prio, CASE kind WHEN 'insert' THEN 'order' WHEN 'trade' THEN 'deal' ELSE 'snapshot' END AS kind FROM book_events"""


@query("st01_three_feeds", """
WITH w AS (SELECT min(wm) AS wm FROM (SELECT max(second) - CASE prio WHEN 0 THEN 2 WHEN 1 THEN 30 ELSE 600 END AS wm FROM feed_rows GROUP BY prio))
SELECT * FROM (SELECT SecuCode, TradingDay, second * 1000 AS at_ms, seq, prio::BIGINT AS prio, kind,
  row_number() OVER (PARTITION BY SecuCode, TradingDay ORDER BY second, prio, seq) AS event_no FROM feed_rows) WHERE at_ms <= (SELECT wm FROM w) * 1000""")
def _(spark, d):
    """Three streams with delays of their own; the slowest watermark decides how far the timeline goes."""
    days = ["SecuCode", "TradingDay"]

    def feed(kind):
        rows = V.book_events(spark, d, stream(spark, d, "orders")).where(F.col("kind") == kind)
        second = F.col("seq") + 1 + F.when(F.col("kind") == "insert", 0).otherwise(F.col("order_id") % 3)
        return rows.select(*days, F.timestamp_seconds(second).alias("ts"), (second * 1000).alias("at_ms"), F.col("order_id").alias("seq"))

    kinds = {"order": ("insert", "2 seconds"), "deal": ("trade", "30 seconds"), "snapshot": ("cancel", "10 minutes")}
    out = O.feeds_timeline({k: (feed(source), delay) for k, (source, delay) in kinds.items()}, days, HOUR_MS)
    return J.materialised(out, "append").select(*days, "at_ms", "seq", "prio", "kind", "event_no")


@query("st05_live_book", """
SELECT SecuCode, TradingDay, seq, order_id, best_bid, best_ask FROM best_prices WHERE seq <= (SELECT max(seq) - 2 FROM book_events)""")
def _(spark, d):
    second = F.col("seq") + 1  # the first instant of the epoch is never ahead of a watermark
    rows = V.book_events(spark, d, stream(spark, d, "orders")).select(
        "SecuCode", "TradingDay", F.timestamp_seconds(second).alias("ts"), (second * 1000).alias("at_ms"), "seq", "kind",
        "order_id", "side", "price", "qty")
    out = J.materialised(O.live_book(rows, ["SecuCode", "TradingDay"], "2 seconds", HOUR_MS), "append")
    return out.select("SecuCode", "TradingDay", "seq", "order_id", "best_bid", "best_ask")


V.VIEW_SQL["true_levels"] = V.VIEW_SQL["snap_levels"].replace("% 9 AS fault", "% 9 * 0 AS fault")


@query("st05_live_checks", """
SELECT SecuCode, TradingDay, snap_no, bool_and(coalesce(a.price = b.price AND a.orders = b.orders AND abs(a.volume - b.volume) <= 20, false)) AS ok
FROM true_levels a FULL JOIN snap_levels b USING (SecuCode, TradingDay, snap_no, side, level)
GROUP BY 1, 2, 3 HAVING max(a.taken) <= (SELECT max(seq) - 2 FROM book_events)""")
def _(spark, d):
    """Snapshots stand in the stream among the events; the levels of the live book are compared with theirs."""
    days = ["SecuCode", "TradingDay"]
    events = V.book_events(spark, d)
    checks = snapshots(spark, d).select(
        *days, F.col("taken").alias("seq"), F.lit("check").alias("kind"), (F.lit(1 << 40) + F.col("snap_no")).alias("order_id"), F.lit("B").alias("side"),
        F.lit(0).cast("bigint").alias("price"), F.lit(0).cast("bigint").alias("qty"), "bids", "asks")
    rows = events.withColumns({c: F.lit(None).cast(checks.schema[c].dataType) for c in ("bids", "asks")}).unionByName(checks)
    second = F.col("seq") + 1
    rows = rows.select(*days, F.timestamp_seconds(second).alias("ts"), (second * 1000).alias("at_ms"), "seq", "kind", "order_id", "side", "price", "qty", "bids", "asks")
    path = work_dir(spark, "book-feed")
    rows.write.parquet(path)
    out = J.materialised(O.live_book(spark.readStream.schema(rows.schema).parquet(path), days, "2 seconds", HOUR_MS), "append")
    return out.where("kind = 'check'").select(*days, (F.col("order_id") - (1 << 40)).alias("snap_no"), "ok")


@query("st07_live_boxes", """
SELECT symbol, start_t, end_t, break_t, box_high, box_low, days FROM price_boxes WHERE break_t < (SELECT max(t) FROM bars_m)""")
def _(spark, d):
    path = work_dir(spark, "bars")
    start = F.col("t").cast("bigint") * 86400
    bars = V.bars_m(spark, d).select(
        "symbol", F.timestamp_seconds(start).alias("ts"), (start * 1000).alias("at_ms"), F.col("t").cast("bigint").alias("bt"),
        *[F.col(c).cast("double").alias(c) for c in ("high", "low", "close")])
    bars.write.parquet(path)
    rows = spark.readStream.schema(bars.schema).parquet(path)
    out = J.materialised(O.live_boxes(rows, ["symbol"], delay="1 day", **BOX), "append")
    return rounded(out.select("symbol", "start_t", "end_t", "break_t", "box_high", "box_low", "days"))


V.VIEW_SQL["traded"] = """
SELECT SecuCode, TradingDay, seq, order_id, qty, sum(qty) OVER (PARTITION BY SecuCode, TradingDay ORDER BY seq, order_id)::BIGINT AS total
FROM book_events WHERE kind = 'trade'"""
V.VIEW_SQL["checks"] = """
SELECT SecuCode, TradingDay, order_id AS seq, CASE order_id % 3 WHEN 0 THEN seq - 1 WHEN 1 THEN seq - 5 ELSE seq END AS second,
  (total + CASE WHEN order_id % 7 = 0 THEN 1 ELSE 0 END)::BIGINT AS volume FROM traded"""


@query("st08_timed_checks", """
WITH m AS (SELECT c.SecuCode, c.TradingDay, c.seq, c.second, min(CASE WHEN t.seq > c.second THEN t.seq WHEN t.seq IS NOT NULL THEN c.second END) AS hit
  FROM checks c LEFT JOIN (SELECT SecuCode, TradingDay, seq, total, coalesce(lead(seq) OVER (PARTITION BY SecuCode, TradingDay ORDER BY seq, order_id), 9223372036854775807) AS until FROM traded) t
  ON t.SecuCode = c.SecuCode AND t.TradingDay = c.TradingDay AND t.total = c.volume AND t.seq <= c.second + 2 AND (t.until > c.second OR t.seq > c.second) GROUP BY 1, 2, 3, 4),
w AS (SELECT max(s) - 2 AS wm FROM (SELECT seq AS s FROM traded UNION ALL SELECT second FROM checks))
SELECT SecuCode, TradingDay, seq, hit IS NOT NULL AS ok, hit * 1000 AS matched_ms FROM m, w
WHERE CASE WHEN hit IS NULL THEN second + 3 ELSE hit END <= wm""")
def _(spark, d):
    """Each trade also leaves a snapshot of the day's volume: in time, early, five seconds early, or one share off."""
    trades = V.book_events(spark, d).where("kind = 'trade'")
    sums = running(trades, ["SecuCode", "TradingDay"], ["seq", "order_id"], "seq div 1000", {"total": ("sum", F.col("qty"))})
    off = F.when(F.col("order_id") % 7 == 0, 1).otherwise(0)
    early = F.when(F.col("order_id") % 3 == 0, 1).when(F.col("order_id") % 3 == 1, 5).otherwise(0)
    day = ["SecuCode", "TradingDay"]
    feed = trades.select(*day, F.col("seq").alias("second"), F.lit("trade").alias("kind"), F.lit(0).cast("bigint").alias("prio"),
                         F.col("order_id").alias("seq"), F.col("qty").alias("volume")).unionByName(
        sums.select(*day, (F.col("seq") - early).alias("second"), F.lit("check").alias("kind"), F.lit(1).cast("bigint").alias("prio"),
                    F.col("order_id").alias("seq"), (F.col("total") + off).alias("volume")))
    feed = feed.select(*day, F.timestamp_seconds("second").alias("ts"), (F.col("second") * 1000).alias("at_ms"), "kind", "prio", "seq", "volume")
    path = work_dir(spark, "checks")
    feed.write.parquet(path)
    out = O.timed_checks(spark.readStream.schema(feed.schema).parquet(path), day, 2000, "2 seconds")
    return J.materialised(out, "append").select(*day, "seq", "ok", "matched_ms")


@query("st08_without_replays", "SELECT event_id, user_id FROM events")
def _(spark, d):
    both = stream(spark, d).unionByName(stream(spark, d)).select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return J.materialised(J.without_replays(both, ["event_id"]), "append").select("event_id", "user_id")


@query("st09_barrier", """
WITH b AS (SELECT (ts_us // 3600000000) * 3600 AS start, count(DISTINCT symbol) AS symbols, sum(volume)::BIGINT AS volume FROM ticks GROUP BY 1)
SELECT start, symbols, volume FROM b, watermark WHERE symbols = 5 AND (start + 3600) * 1000 <= wm""")
def _(spark, d):
    return seconds(J.materialised(J.barrier(live_ticks(spark, d), "symbol", "1 hour", 5), "append"), "start")


@query("st10_refresh_table", "SELECT symbol, ts_us, price, volume FROM ticks")
def _(spark, d):
    path = work_dir(spark, "refreshed")
    rows = live_ticks(spark, d).select("symbol", F.unix_micros("ts").alias("ts_us"), "price", "volume")
    noon = V.ticks(spark, d).agg(F.expr("(min(ts_us) + max(ts_us)) div 2")).first()[0]
    for part in (rows.where(F.col("ts_us") <= noon), rows, rows):  # first half, the rest, and a replay that adds nothing
        ledger = J.refresh_table(part, path, ["symbol"], "ts_us")
    return ledger.rows()
