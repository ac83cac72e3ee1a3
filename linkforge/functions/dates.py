"""Two-calendar date normalisation."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import latin_digits

# The markers of either calendar and the years that decide without one.
MARKERS = {"BS": ("बि.सं", "वि.सं", "बिस", "b.s", "bs "), "AD": ("ई.सं", "ईस्वी", "a.d", "ad ")}
AD_YEAR_MAX, BS_YEAR_MIN, BS_YEAR_FLOOR, BS_YEAR_CEIL = 2050, 2051, 1975, 2100

# Lengths of the twelve BS months. Each year starts where the year before it ends; the
# first of 2070 is 14 April 2013. Years that are not listed stay unknown: published tables differ there.
BS_MONTHS = {
    2070: (31, 31, 31, 32, 31, 31, 29, 30, 30, 29, 30, 30),
    2071: (31, 31, 32, 31, 31, 31, 30, 29, 30, 29, 30, 30),
    2072: (31, 32, 31, 32, 31, 30, 30, 29, 30, 29, 30, 30),
    2073: (31, 32, 31, 32, 31, 30, 30, 30, 29, 29, 30, 31),
    2074: (31, 31, 31, 32, 31, 31, 30, 29, 30, 29, 30, 30),
    2075: (31, 31, 32, 31, 31, 31, 30, 29, 30, 29, 30, 30),
    2076: (31, 32, 31, 32, 31, 30, 30, 30, 29, 29, 30, 30),
    2077: (31, 32, 31, 32, 31, 30, 30, 30, 29, 30, 29, 31),
    2078: (31, 31, 31, 32, 31, 31, 30, 29, 30, 29, 30, 30),
    2079: (31, 31, 32, 31, 31, 31, 30, 29, 30, 29, 30, 30),
    2080: (31, 32, 31, 32, 31, 30, 30, 30, 29, 29, 30, 30),
    2081: (31, 31, 32, 32, 31, 30, 30, 30, 29, 30, 30, 30),
    2082: (31, 31, 32, 31, 31, 31, 30, 29, 30, 29, 30, 30),
    2083: (31, 31, 32, 31, 31, 30, 30, 30, 29, 30, 30, 30),
}
BS_EPOCH = date(2013, 4, 14)

NORMALIZED = "calendar", "normalized"


def bs_rows() -> list[tuple[int, int, int, date]]:
    out, at = [], BS_EPOCH
    for year, months in sorted(BS_MONTHS.items()):
        for month, days in enumerate(months, 1):
            out.append((year, month, days, at))
            at += timedelta(days=days)
    return out


def bs_calendar(spark: SparkSession) -> DataFrame:
    """bs_year, bs_month, bs_days, ad_start: twelve rows a year, so always small enough to broadcast."""
    return spark.createDataFrame(bs_rows(), "bs_year int, bs_month int, bs_days int, ad_start date")


def marker(raw: Column) -> Column:
    low = F.lower(raw)
    has = lambda name: F.greatest(*[F.contains(low, F.lit(m)) for m in MARKERS[name]])
    return F.when(has("BS"), "BS").when(has("AD"), "AD")


def normalize_dates(df: DataFrame, raw: str = "event_date", calendar: DataFrame | None = None) -> DataFrame:
    """`df` with `calendar_type` (BS, AD or unknown) and `event_date_normalized` (DATE or NULL)."""
    calendar = calendar if calendar is not None else bs_calendar(df.sparkSession)
    text = latin_digits(F.trim(F.col(raw)))
    part = lambda k: F.nullif(F.regexp_extract(text, r"([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})", k), F.lit("")).try_cast("int")
    d = df.withColumns({"_y": part(1), "_m": part(2), "_d": part(3), "_mark": marker(F.col(raw))})
    d = d.withColumn(
        "_calendar",
        F.when(F.col("_y").isNull(), "unknown")
        .when((F.col("_mark") == "AD") | (F.col("_mark").isNull() & (F.col("_y") <= AD_YEAR_MAX)), "AD")
        .when(F.col("_y").between(BS_YEAR_FLOOR, BS_YEAR_CEIL), "BS")
        .otherwise("unknown"),
    )
    d = d.join(F.broadcast(calendar), (F.col("_calendar") == "BS") & (F.col("_y") == F.col("bs_year")) & (F.col("_m") == F.col("bs_month")), "left")
    ad = F.try_to_date(F.format_string("%04d-%02d-%02d", "_y", "_m", "_d"), "yyyy-MM-dd")
    bs = F.when(F.col("_d").between(1, F.col("bs_days")), F.date_add("ad_start", F.col("_d") - 1))
    out = F.when(F.col("_calendar") == "AD", ad).when(F.col("_calendar") == "BS", bs)
    d = d.withColumn("event_date_normalized", out)
    return d.withColumn("calendar_type", F.when(F.col("event_date_normalized").isNull(), "unknown").otherwise(F.col("_calendar"))).drop(
        "_y", "_m", "_d", "_mark", "_calendar", "bs_year", "bs_month", "bs_days", "ad_start"
    )


def stored_or_normalized(df: DataFrame, stored: str = "event_date_normalized", raw: str = "event_date") -> DataFrame:
    """`df` with `event_day`: the stored ISO date, else the raw one normalised; a malformed one is unknown."""
    kept = df.withColumn("_stored", F.try_to_date(F.nullif(F.col(stored).cast("string"), F.lit("")), "yyyy-MM-dd")).drop("calendar_type", stored)
    return normalize_dates(kept, raw).withColumn("event_day", F.coalesce("_stored", "event_date_normalized")).drop("_stored", "event_date_normalized")


def day_gap(am: Column, pm: Column) -> Column:
    return F.datediff(pm, am)
