"""The driver tables as inputs of the screener.

They hold no price bars, universe or theme reports, so bars are built from
line items, names from parts and suppliers, and theme reports from events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from updraft.functions.numeric import ratio
from updraft.operators.bars import build_bars


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unit_price() -> Column:
    return ratio(F.col("l_extendedprice"), F.col("l_quantity"))


def line_bars(lines: DataFrame, code: Column, date: Column) -> DataFrame:
    order = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return build_bars(
        lines, code=code, date=date, price=unit_price(), quantity=F.col("l_quantity"),
        order=[F.col(c) for c in order],
    )


def part_month_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return line_bars(lines, F.col("l_partkey"), F.trunc("l_shipdate", "month"))


def supplier_week_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return line_bars(lines, F.col("l_suppkey"), F.trunc("l_shipdate", "week"))


def brand_day_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily quotes of all brands as one wide frame, columns ``ticker|field``.

    A brand without a trade on a day leaves gaps, as vendor frames do.
    """
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    # Column names of the wide frame: a few brands.
    brands = sorted(r["p_brand"] for r in part.select("p_brand").distinct().dropna().collect())
    lines = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    bars = line_bars(lines, F.col("p_brand"), F.to_date("l_shipdate"))
    wide = (
        bars.groupBy("date").pivot("code", brands)
        .agg(F.first("open").alias("o"), F.first("close").alias("c"), F.first("volume").alias("v"))
    )
    renamed = [F.col("date").alias("Date")]
    for brand in brands:
        for short, field in (("o", "Open"), ("c", "Close"), ("v", "Volume")):
            renamed.append(F.col(f"`{brand}_{short}`").alias(f"{brand}.T|{field}"))
    return wide.select(*renamed)


def part_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as (code, name, market), the type standing for a market."""
    kind = F.col("p_type")
    market = (
        F.when(kind.isin("STANDARD", "MEDIUM"), F.lit("スタンダード"))
        .when(kind.isin("PROMO", "LARGE"), F.lit("プライム"))
        .when(kind == "SMALL", F.lit("グロース"))
    )
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("code"),
        F.col("p_name").alias("name"), market.alias("market"),
    )


def raw_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as untyped quotes: gaps in close, fractional volumes."""
    close = unit_price() * (1 - F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("date"),
        unit_price().alias("open"),
        F.when(F.col("l_returnflag") != "R", close).alias("close"),
        (F.col("l_quantity") * (1 + F.col("l_tax"))).alias("volume"),
    )


def line_quotes(lines: DataFrame) -> DataFrame:
    """Line items as one quote each, many to a (code, date), with a sequence."""
    return lines.select(
        F.col("l_suppkey").cast("string").alias("code"),
        F.to_date("l_shipdate").alias("date"),
        unit_price().alias("open"),
        (unit_price() * (1 - F.col("l_discount"))).alias("close"),
        F.col("l_quantity").cast("bigint").alias("volume"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        "l_linestatus",
    )


def theme_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily theme reports: a theme per event type, figures from its events."""
    cents = F.round(F.col("value") * 100, 0).cast("bigint")
    daily = (
        table(spark, sf_dir, "events")
        .select(
            F.date_format("ts", "yyyy-MM-dd").alias("report_date"),
            F.col("event_type").alias("theme"), "user_id", cents.alias("cents"),
        )
        .groupBy("report_date", "theme")
        .agg(
            F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"),
            F.sum("cents").alias("total"), F.max("cents").alias("top"),
        )
    )
    n, users = F.col("n"), F.col("users")
    measured = daily.withColumn("confidence", F.col("total") / n / 100 - 50)
    by_confidence = Window.partitionBy("report_date").orderBy(F.col("confidence").desc(), "theme")
    return measured.select(
        F.row_number().over(by_confidence).alias("rank"), "theme",
        F.when(n >= 75, F.lit("初動")).when(n >= 66, F.lit("監視中"))
        .when(n < 58, F.lit("失速")).alias("status"),
        F.when(F.col("top") > 30000, F.lit("再点火")).alias("ignition"),
        F.when(F.col("confidence") > 5, F.lit("S2 継続"))
        .when(F.col("confidence") > 0, F.lit("S1 点火")).alias("stage"),
        "confidence",
        users.cast("int").alias("participants"), n.cast("int").alias("eligible_members"),
        (users / n).alias("participation_rate"),
        (F.col("top") / F.col("total")).alias("concentration"),
        (F.col("confidence") / 8).alias("turnover_anomaly"),
        ((F.col("top") - 25000) / F.lit(7000.0)).alias("mkt_rel_z"),
        ((users - 50) / F.lit(16.0)).alias("breadth_z"),
        F.when(users >= 55, True).when(users < 48, False).alias("floor_pass"),
        F.when(n < 60, True).alias("small_universe"),
        F.when(n >= 60, F.concat(F.lit("max "), F.col("top").cast("string")))
        .alias("top_contributors"),
        F.when(n >= 70, F.col("report_date")).alias("registered_since"),
        F.lit(None).cast("string").alias("last_ignition"),
        "report_date",
    )
