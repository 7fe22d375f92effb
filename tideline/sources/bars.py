"""Bar files: schema-checked scan, partitioned sink, pruned reload."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PRICES = ["open", "high", "low", "close"]


def read_bars(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """CSV or Parquet by suffix; names lowered and trimmed; volume defaults to 0; missing prices fail early."""
    reader = spark.read.option("header", True).option("inferSchema", True).csv if path.endswith(".csv") else spark.read.parquet
    df = reader(path)
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    missing = [c for c in PRICES if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    when = next(c for c in ("ts", "date", "time") if c in df.columns)
    df = df.withColumnRenamed(when, "ts").selectExpr("*", *([] if "volume" in df.columns else ["0.0D AS volume"]))
    df = df.withColumn("ts", df["ts"].cast("timestamp"))
    return df.where(df["symbol"] == symbol) if symbol and "symbol" in df.columns else df


def write_bars(bars: DataFrame, path: str, timeframe: str) -> None:
    """zstd Parquet partitioned by timeframe and symbol; a hot symbol is split over files by month."""
    b = bars.selectExpr("*", f"'{timeframe}' AS timeframe", "trunc(ts, 'MM') AS _m").repartition("symbol", "_m").drop("_m")
    b.write.mode("overwrite").partitionBy("timeframe", "symbol").option("compression", "zstd").parquet(path)


def reload_bars(spark: SparkSession, path: str, timeframe: str, symbol: str | None = None) -> DataFrame:
    """Partition-pruned read back."""
    df = spark.read.parquet(path).where(f"timeframe = '{timeframe}'")
    return df.where(f"symbol = '{symbol}'") if symbol else df
