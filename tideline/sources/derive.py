"""Bar tables and companion series derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import panel as P
from ..operators import research as X
from ..operators import signals as G
from .store import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks_to_bars(ticks: DataFrame, bucket, price: str, size: str, tie: list[str], key: str = "symbol") -> DataFrame:
    """Ticks -> OHLCV bars. One partial aggregate per (symbol, bucket); no sort."""
    order = F.struct(*tie)
    return ticks.groupBy(key, bucket.alias("ts")).agg(
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        F.sum(size).cast("double").alias("volume"),
    )


# the tie key is unique in lineitem, (l_orderkey, l_linenumber) is not
_TIE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def daily_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("symbol"), "l_shipdate", *_TIE
    )


def bars_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks_to_bars(daily_ticks(spark, sf_dir), F.to_date("l_shipdate"), "l_extendedprice", "l_quantity", _TIE)


def bars_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), F.col("ts").alias("tick_ts"), "event_id", "value", F.lit(1.0).alias("one")
    )
    return ticks_to_bars(ev, F.date_trunc("hour", "tick_ts"), "value", "one", ["tick_ts", "event_id"])


def flow_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net order flow per symbol and day: quantity minus the typical 25.5 per line."""
    li = daily_ticks(spark, sf_dir).withColumn("ts", F.to_date("l_shipdate"))
    return li.groupBy("symbol", "ts").agg(
        F.expr("cast(sum(l_quantity) - 25.5 * count(*) as double) AS step"),
        F.expr("max(l_quantity) / 2 AS hi"),
        F.expr("25.5 - min(l_quantity) / 2 AS lo"),
        F.expr("cast(sum(l_quantity) as double) AS volume"),
    )


def walk_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of a cumulative order-flow index: a trending series with small daily ranges.

    The level is a running total over all earlier days; steps are halves, so it is exact.
    """
    own = P.own_rows(P.chunked(flow_days(spark, sf_dir)))
    c = P.scan(own, {"flow": ("step", 1.0)})
    c = c.selectExpr("symbol", "ts", "rn", "20000 + flow - step AS open", "20000 + flow AS close", "hi", "lo", "volume")
    return c.selectExpr(
        "symbol", "ts", "open", "greatest(open, close) + hi AS high", "least(open, close) - lo AS low", "close", "volume", "rn"
    )


def panel_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature panel of ``walk_d``, stored once per application."""
    return stored(spark, "panel_d", sf_dir, lambda: G.feature_panel(walk_d(spark, sf_dir)))


def research_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Research panel of ``walk_d``, stored once per application."""
    return stored(spark, "research_d", sf_dir, lambda: X.research_panel(panel_d(spark, sf_dir)))
