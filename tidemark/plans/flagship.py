"""The minimum end-to-end query: ticks to a last-bar screen."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.series import open_series
from tidemark.operators.screens import latest
from tidemark.plans import views as V
from tidemark.plans.catalog import query
from tidemark.session import stage

MONTH_OF_BARS = "ts div 2592000"


@query("flagship_breakout_screen", """
WITH w AS (
  SELECT symbol, ts, close,
         CASE WHEN row_number() OVER p >= 20 THEN avg(close) OVER (p ROWS 19 PRECEDING) END AS sma20,
         volume / avg(volume) OVER (p ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS vol_ratio,
         row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rd
  FROM bars_h WINDOW p AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, ts, close, round(sma20, 6) AS sma20, round(vol_ratio, 6) AS vol_ratio,
       close > sma20 AS above FROM w WHERE rd = 1""")
def breakout_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = open_series(stage(V.bars_h(spark, sf_dir)), ["symbol"], ["ts"], MONTH_OF_BARS, back=20)
    s = s.add(
        sma20=s.sma("close", 20),
        vol_ratio=F.col("volume") / F.avg("volume").over(s.rows(-5, -1)),
    )
    last = latest(s.close().select("symbol", "ts", "close", "sma20", "vol_ratio"), ["symbol"], "ts")
    return last.select(
        "symbol", "ts", "close", F.round("sma20", 6).alias("sma20"),
        F.round("vol_ratio", 6).alias("vol_ratio"), (F.col("close") > F.col("sma20")).alias("above"),
    )
