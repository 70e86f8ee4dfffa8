"""Bar store and fill journal: schemas, idempotent upserts, scans, ingest."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..plans.lineage import cut

BAR_PK = ("symbol", "exchange", "interval", "ts")
FILL_PK = ("id", "exchange")


def _f(name: str, kind, null: bool = False) -> T.StructField:
    return T.StructField(name, kind, null)


BARS_SCHEMA = T.StructType(
    [_f(c, T.StringType()) for c in ("symbol", "exchange", "interval")]
    + [_f("ts", T.TimestampType()), _f("asset_type", T.StringType())]
    + [_f(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")])

FILLS_SCHEMA = T.StructType(
    [_f(c, T.StringType()) for c in ("id", "exchange", "symbol", "side", "type")]
    + [_f("amount", T.DoubleType())]
    + [_f(c, T.DoubleType(), True) for c in ("price", "cost", "fee")]
    + [_f("fee_currency", T.StringType(), True), _f("ts", T.TimestampType())]
    + [_f(c, T.StringType(), True) for c in ("order_id", "strategy")])

# Exchange-traded funds the asset classifier knows.
ETF_SYMBOLS = ("SPY", "QQQ", "IWM", "DIA", "VOO", "VTI", "VEA", "VWO",
               "GLD", "SLV", "TLT", "HYG", "LQD", "XLF", "XLE", "XLK",
               "XLV", "XLI", "XLP", "XLU", "XLB", "XLY", "XLRE",
               "ARKK", "ARKW", "ARKG", "ARKF", "ARKQ",
               "IBIT", "FBTC", "GBTC", "ETHE", "BITO")


def keep_last(df: DataFrame, pk, order: list[str]) -> DataFrame:
    """One row per key, the one with the greatest ``order``; an aggregate, so map-side combined."""
    rest = [c for c in df.columns if c not in pk]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(*pk).agg(best).select(*pk, *[F.col(f"_r.{c}").alias(c) for c in rest]) \
        .select(*df.columns)


def upsert(existing: DataFrame, new: DataFrame, pk, seq: str | None = None) -> DataFrame:
    """Later rows with the same key win: new over existing, higher ``seq`` within new.

    Without ``seq`` the rows of ``new`` must have different keys; ``upsert_path`` checks that.
    """
    cols = existing.columns
    s = F.col(seq).cast("long") if seq else F.lit(0).cast("long")
    a = existing.select(*cols, F.lit(0).alias("_gen"), F.lit(0).cast("long").alias("_seq"))
    b = new.select(*cols, F.lit(1).alias("_gen"), s.alias("_seq"))
    return keep_last(a.unionByName(b), pk, ["_gen", "_seq"]).select(*cols)


def upsert_bars(existing: DataFrame, new: DataFrame, seq: str | None = None) -> DataFrame:
    return upsert(existing, new, BAR_PK, seq)


def journal_upsert(existing: DataFrame, new: DataFrame, seq: str | None = None) -> DataFrame:
    return upsert(existing, new, FILL_PK, seq)


def write_bars(df: DataFrame, path: str) -> None:
    """Partitioned by interval and month, sorted so row groups skip on symbol and ts.

    Rows are rebalanced, so a month with many rows is written by as many tasks as its size asks for.
    """
    out = df.withColumn("month", F.date_format("ts", "yyyy-MM"))
    (out.hint("rebalance", "interval", "month")
     .sortWithinPartitions("interval", "month", "symbol", "ts").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("interval", "month").parquet(path))


# Partition values are read with this schema: inference would take the interval "1d" for a number.
STORED_SCHEMA = T.StructType([*BARS_SCHEMA.fields, _f("month", T.StringType())])


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORED_SCHEMA).parquet(path).select(*BARS_SCHEMA.fieldNames())


def upsert_path(new: DataFrame, path: str, seq: str | None = None) -> None:
    """Merge into stored bars; only the (interval, month) folders that get rows are read and rewritten.

    Without ``seq`` a key that repeats within ``new`` raises ValueError. Folders are replaced one by one,
    so a reader may see some months new and others old while the write runs.
    """
    spark, cols = new.sparkSession, BARS_SCHEMA.fieldNames()
    if seq is None and not new.groupBy(*BAR_PK).count().filter("count > 1").isEmpty():
        raise ValueError("new rows repeat a key; name a seq column")
    if not _exists(spark, path):
        write_bars((keep_last(new, BAR_PK, [seq]) if seq else new).select(*cols), path)
        return
    touched = new.groupBy("interval").agg(F.collect_set(F.date_format("ts", "yyyy-MM")).alias("months")).collect()  # folders
    where = F.lit(False)
    for r in touched:
        where = where | ((F.col("interval") == r["interval"]) & F.col("month").isin(r["months"]))
    old = spark.read.schema(STORED_SCHEMA).parquet(path).filter(where).select(*cols)
    write_bars(cut(upsert_bars(old, new, seq)), path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def query_bars(df: DataFrame, symbol: str | None = None, interval: str | None = None,
               exchange: str | None = None, start=None, end=None, limit: int | None = None,
               latest: bool = False) -> DataFrame:
    """Inclusive time range, ordered by ts; ``limit`` keeps the oldest rows, or the newest if ``latest``."""
    for c, v in (("symbol", symbol), ("interval", interval), ("exchange", exchange)):
        if v is not None:
            df = df.filter(F.col(c) == v)
    if start is not None:
        df = df.filter(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.filter(F.col("ts") <= F.lit(end).cast("timestamp"))
    if limit is not None:
        df = df.orderBy(F.col("ts").desc() if latest else F.col("ts"), "symbol").limit(limit)
    return df.orderBy("ts", "symbol")


def list_symbols(df: DataFrame) -> DataFrame:
    return df.groupBy("symbol", "exchange", "asset_type").agg(
        F.sort_array(F.collect_set("interval")).alias("intervals"),
        F.count(F.lit(1)).alias("n_bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def last_timestamp(df: DataFrame) -> DataFrame:
    return df.groupBy("symbol", "exchange", "interval").agg(F.max("ts").alias("last_ts"))


def count_bars(df: DataFrame, symbol: str | None = None, interval: str | None = None) -> DataFrame:
    for c, v in (("symbol", symbol), ("interval", interval)):
        if v is not None:
            df = df.filter(F.col(c) == v)
    return df.agg(F.count(F.lit(1)).alias("n_bars"))


_WRITES = re.compile(r"\b(insert|update|delete|drop|alter|create|copy|attach|replace|truncate|merge|"
                     r"refresh|cache|load|add|set)\b", re.I)


def sql(spark: SparkSession, text: str, args: dict | None = None, guard: bool = False,
        limit: int | None = None) -> DataFrame:
    """Parameterised SQL over the registered views; ``guard`` accepts SELECT only."""
    if guard:
        bare = re.sub(r"'[^']*'", "''", text)
        if not re.match(r"\s*(select|with)\b", bare, re.I) or _WRITES.search(bare) or ";" in bare:
            raise ValueError("only SELECT statements are allowed")
    out = spark.sql(text, args=args) if args else spark.sql(text)
    return out.limit(limit) if limit else out


_SYMBOL = re.compile(r"^[A-Za-z0-9/._:#^-]+$")
_FRAME = re.compile(r"^\d+[smhdwM]$")


def export_parquet(df: DataFrame, path: str, symbol: str | None = None,
                   interval: str | None = None) -> DataFrame:
    """Write the (filtered) bars as Parquet; returns the written rows for counting."""
    if symbol is not None and not _SYMBOL.match(symbol):
        raise ValueError(f"bad symbol {symbol!r}")
    if interval is not None and not _FRAME.match(interval):
        raise ValueError(f"bad timeframe {interval!r}")
    for c, v in (("symbol", symbol), ("interval", interval)):
        df = df if v is None else df.filter(F.col(c) == v)
    df.sortWithinPartitions("symbol", "ts").write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def import_parquet(existing: DataFrame, path: str) -> DataFrame:
    """Upsert all rows of a Parquet file, matched by column name."""
    cols = existing.columns
    return upsert_bars(existing, existing.sparkSession.read.parquet(path).select(*cols))


def ingest_exchange_batch(stored: DataFrame, landing: DataFrame, exchange: str, interval: str,
                          asset_type: str = "crypto") -> DataFrame:
    """Landing rows newer than what is stored per symbol, stamped; append or upsert the result."""
    last = last_timestamp(stored).filter(
        (F.col("exchange") == exchange) & (F.col("interval") == interval)).select("symbol", "last_ts")
    fresh = landing.join(last, "symbol", "left").filter(
        F.col("last_ts").isNull() | (F.col("ts") > F.col("last_ts"))).drop("last_ts")
    out = (fresh.withColumn("exchange", F.lit(exchange)).withColumn("interval", F.lit(interval))
           .withColumn("asset_type", F.lit(asset_type)))
    return out.select(*[c for c in BARS_SCHEMA.fieldNames() if c in out.columns])


def ingest_report(fresh: DataFrame) -> DataFrame:
    return fresh.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_new"), F.max("ts").alias("last_ts"))


def detect_asset_type(symbol: Column) -> Column:
    s = F.upper(symbol)
    return (F.when(s.rlike("-(USD|EUR|GBP)"), "crypto").when(s.isin(*ETF_SYMBOLS), "etf")
            .when(s.startswith("^"), "index").otherwise("stock"))


def ingest_quotes_file(stored: DataFrame, landing: DataFrame, exchange: str, interval: str,
                       years_back: int = 5) -> DataFrame:
    """Daily-quote file rows: no null prices, null volume is 0, only rows after the stored end."""
    clean = (landing.dropna(subset=["open", "high", "low", "close"])
             .withColumn("volume", F.coalesce("volume", F.lit(0.0)))
             .withColumn("symbol", F.upper("symbol")))
    last = last_timestamp(stored).filter(
        (F.col("exchange") == exchange) & (F.col("interval") == interval)).select("symbol", "last_ts")
    newest = clean.groupBy("symbol").agg(
        (F.max("ts") - F.expr(f"interval {years_back} years")).alias("_floor"))
    out = (clean.join(last, "symbol", "left").join(newest, "symbol")
           .filter(F.when(F.col("last_ts").isNotNull(), F.col("ts") > F.col("last_ts"))
                   .otherwise(F.col("ts") >= F.col("_floor"))))
    return out.select("symbol", F.lit(exchange).alias("exchange"), F.lit(interval).alias("interval"),
                      "ts", detect_asset_type(F.col("symbol")).alias("asset_type"),
                      "open", "high", "low", "close", "volume")


def trades_to_1s_bars(ticks: DataFrame) -> DataFrame:
    """One-second bars; open and close follow arrival order (ts, seq)."""
    o = F.struct("ts", "seq")
    return (ticks.filter(F.col("ts").isNotNull())
            .groupBy("symbol", F.date_trunc("second", "ts").alias("bar_ts"))
            .agg(F.min_by("price", o).alias("open"), F.max("price").alias("high"),
                 F.min("price").alias("low"), F.max_by("price", o).alias("close"),
                 F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n_trades"))
            .withColumn("interval", F.lit("1s")))


def merge_cache_delta(cached: DataFrame, fresh: DataFrame, limit: int) -> DataFrame:
    """Cached rows win over fresh ones with the same key; the last ``limit`` per series remain."""
    cols = cached.columns
    both = cached.withColumn("_src", F.lit(1)).unionByName(
        fresh.select(*cols).withColumn("_src", F.lit(0)))
    merged = keep_last(both, BAR_PK, ["_src"]).select(*cols)
    w = Window.partitionBy("symbol", "exchange", "interval").orderBy(F.col("ts").desc())
    return merged.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= limit).drop("_k")


def journal_query(df: DataFrame, start=None, end=None, limit: int | None = None, **equal) -> DataFrame:
    """Fills by equality filters and inclusive time range, newest first."""
    for c, v in equal.items():
        if v is not None:
            df = df.filter(F.col(c) == v)
    if start is not None:
        df = df.filter(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.filter(F.col("ts") <= F.lit(end).cast("timestamp"))
    df = df.orderBy(F.col("ts").desc(), F.col("id").desc())
    if limit is not None:
        if limit <= 0:
            raise ValueError("limit must be positive")
        df = df.limit(limit)
    return df
