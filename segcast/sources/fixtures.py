"""Views of the driver's test tables in the shapes the engine consumes.

* ``hourly``        – lineitem ⋈ supplier: one hourly observation per line item,
                      segment = supplier nation, count = returned line.
* ``event_records`` – orders ⋈ customer ⋈ nation ⋈ region: one event per order.
* ``registry``      – nation: segment id → route/segment code.

All three are plain lazy DataFrames; Catalyst prunes the parquet columns and
chooses the join strategy from table statistics (the dimension sides here are
tiny, so AQE broadcasts them; nothing is force-broadcast that can grow).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hour_of(orderkey: Column, linenumber: Column) -> Column:
    return F.pmod(orderkey * 7 + linenumber, F.lit(24)).cast("int")


def hourly(spark: SparkSession, sf_dir: str, segment: str = "nation") -> DataFrame:
    """Hourly observations (FIXTURES §2.1).

    ``segment='nation'`` keys by supplier nation (25 segments);
    ``segment='supplier'`` keys by ``l_suppkey`` for the many-segment scaling runs.
    """
    li = table(spark, sf_dir, "lineitem")
    hour = _hour_of(F.col("l_orderkey"), F.col("l_linenumber"))
    if segment == "supplier":
        base = li
        seg = F.concat(F.lit("sup_"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0"))
    else:
        sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
        base = li.join(sup, li.l_suppkey == sup.s_suppkey)
        seg = F.concat(F.lit("seg_"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0"))
    return base.select(
        seg.alias("segment_id"),
        (F.col("l_shipdate") + F.make_dt_interval(F.lit(0), hour)).alias("timestamp"),
        (F.col("l_returnflag") == "R").cast("int").alias("crash_count"),
        F.col("l_quantity").alias("speed"),
        F.lit(25.5).cast("double").alias("historical_average_speed"),
        F.when(F.col("l_linenumber") == 1, 0.0).otherwise(40.0).cast("double").alias("reference_speed"),
        (F.col("l_extendedprice") / 1000).alias("npmrds"),
        hour.alias("hour"),
        F.dayofweek("l_shipdate").isin(1, 7).cast("int").alias("is_weekend"),
    )


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Individual event records (FIXTURES §2.2), snake_case columns."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    j = (o.join(c, o.o_custkey == c.c_custkey)
          .join(n, F.col("c_nationkey") == n.n_nationkey)
          .join(r, F.col("n_regionkey") == r.r_regionkey))
    light = (F.when(F.col("o_orderkey") % 97 == 0, F.lit(None).cast("string"))
              .when(F.col("o_orderpriority") == "1-URGENT", "Daylight")
              .when(F.col("o_orderpriority") == "2-HIGH", "Dark-Lighted")
              .when(F.col("o_orderpriority") == "3-MEDIUM", "Dark-Unknown")
              .when(F.col("o_orderpriority") == "5-LOW", "Dusk")
              .otherwise("Other"))
    return j.select(
        F.col("r_name").alias("route"),
        F.col("n_name").alias("segment_id"),
        F.year("o_orderdate").alias("year_of_crash"),
        F.when(F.col("o_orderkey") % 50 == 0, "unknown")
         .otherwise(F.date_format("o_orderdate", "MM/dd/yyyy")).alias("date_of_crash"),
        F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("No").alias("hit_and_run"),
        light.alias("light_condition"),
    )


# Route code per region key (FIXTURES §2.3): 0 I0040, 1 I0055, 2 I0240, 3 I55, 4 I240.
ROUTE_BY_REGION = ["I0040", "I0055", "I0240", "I55", "I240"]


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment registry: ``segment_id`` → ``route_segment`` (e.g. ``I0040_Seg03``)."""
    n = table(spark, sf_dir, "nation")
    route = F.element_at(F.array(*[F.lit(r) for r in ROUTE_BY_REGION]), F.col("n_regionkey") + 1)
    key = F.lpad(F.col("n_nationkey").cast("string"), 2, "0")
    return n.select(
        F.concat(F.lit("seg_"), key).alias("segment_id"),
        F.concat(route, F.lit("_Seg"), key).alias("route_segment"),
    )
