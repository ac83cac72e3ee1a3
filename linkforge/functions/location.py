"""Tiered location compatibility. Normal forms are made once for each record, before any pair."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import normalize_ascii

# Names of the seven provinces as they are spelled and numbered.
PROVINCES = {
    "koshi": ("कोशी प्रदेश", "कोशी", "प्रदेश नं १", "प्रदेश न १", "प्रदेश १"),
    "madhesh": ("मधेश प्रदेश", "मधेश", "प्रदेश नं २", "प्रदेश न २", "प्रदेश २"),
    "bagmati": ("बागमती प्रदेश", "बागमती", "प्रदेश नं ३", "प्रदेश न ३", "प्रदेश ३"),
    "gandaki": ("गण्डकी प्रदेश", "गण्डकी", "प्रदेश नं ४", "प्रदेश न ४", "प्रदेश ४"),
    "lumbini": ("लुम्बिनी प्रदेश", "लुम्बिनी", "प्रदेश नं ५", "प्रदेश न ५", "प्रदेश ५"),
    "karnali": ("कर्णाली प्रदेश", "कर्णाली", "प्रदेश नं ६", "प्रदेश न ६", "प्रदेश ६"),
    "sudurpashchim": ("सुदूरपश्चिम प्रदेश", "सुदूरपश्चिम", "प्रदेश नं ७", "प्रदेश न ७", "प्रदेश ७"),
}
TIERS = (("municipality", 1.0), ("district", 0.8), ("province", 0.6))
STRONG, WEAK, UNKNOWN, NONE, CONFLICT = 0.75, 0.55, 0.5, 0.35, 0.25


def canonical_province(normal: Column) -> Column:
    """First province of which a spelling is in the normalised text."""
    out = F.lit(None).cast("string")
    for name, spellings in reversed(PROVINCES.items()):
        out = F.when(F.greatest(*[F.contains(normal, F.lit(s)) for s in spellings]), name).otherwise(out)
    return out


def location_tokens(normal: Column) -> Column:
    return F.array_distinct(F.split(normal, " "))


def with_profile(df: DataFrame, normalize: Callable[[Column], Column] = normalize_ascii) -> DataFrame:
    """`df` with n_location, n_province, n_district, n_municipality (NULL where blank), tokens and canon."""
    blank = lambda c: F.nullif(c, F.lit(""))
    out = df.withColumns({f"n_{c}": blank(normalize(F.col(c))) for c in ("location", "province", "district", "municipality")})
    return out.withColumns({"tokens": location_tokens(F.col("n_location")), "canon": canonical_province(F.coalesce("n_province", "n_location"))})


def location_score(a: str = "am_", p: str = "pm_") -> Column:
    c = lambda side, name: F.col(f"{side}{name}")
    out = None
    for name, score in TIERS:
        x, y = c(a, f"n_{name}"), c(p, f"n_{name}")
        hit = (x == y) | (y.isNull() & F.contains(c(p, "n_location"), x)) | (x.isNull() & F.contains(c(a, "n_location"), y))
        out = F.when(hit, score) if out is None else out.when(hit, score)
    shared = F.size(F.array_intersect(c(a, "tokens"), c(p, "tokens")))
    return (
        out.when(c(a, "n_location").isNull() | c(p, "n_location").isNull(), UNKNOWN)
        .when(shared >= 2, STRONG)
        .when(shared == 1, WEAK)
        .when(c(a, "canon") != c(p, "canon"), CONFLICT)
        .otherwise(NONE)
    )
