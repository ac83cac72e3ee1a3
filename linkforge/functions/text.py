"""Cleaning and parsing scalars, as column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEVANAGARI, LATIN = "०१२३४५६७८९", "0123456789"

NUMBER = r"^\s*[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?\s*$"

# Spellings of the recorded sex and the placeholder name of unidentified records.
SEX_WORDS = {"पुरुष": "male", "महिला": "female", "अन्य": "other", "male": "male", "female": "female"}
UNIDENTIFIED = "नखुलेको"
IMAGE_ROOT = "data/raw/images/"


def latin_digits(c: Column) -> Column:
    return F.translate(c, DEVANAGARI, LATIN)


def clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def all_numbers(c: Column) -> Column:
    found = F.regexp_extract_all(latin_digits(F.coalesce(c, F.lit(""))), F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    return F.transform(found, lambda x: x.cast("double"))


def to_float(c: Column) -> Column:
    """Numbers; anything else is NULL."""
    return F.when(c.rlike(NUMBER), F.trim(c).try_cast("double"))


def height_to_cm(c: Column) -> Column:
    """Feet and inches where a foot word stands, else centimetres; bare numbers under 9 are feet."""
    n = all_numbers(c)
    a, b = F.get(n, F.lit(0)), F.get(n, F.lit(1))
    foot = F.contains(c, F.lit("फिट")) | F.lower(c).rlike(r"\bft\b")
    cm = F.contains(F.lower(c), F.lit("cm")) | F.contains(c, F.lit("से"))
    feet = lambda x, inches: F.round(x * 30.48 + inches * 2.54, 1)
    return F.when(c.isNull() | a.isNull(), None).when(foot, feet(a, F.coalesce(b, F.lit(0.0)))).when(cm, a).when(a < 9, feet(a, F.lit(0.0))).otherwise(a)


def canonical_sex(c: Column) -> Column:
    raw = F.lower(F.trim(c))
    out = raw
    for word, value in SEX_WORDS.items():
        out = F.when(raw == word, value).otherwise(out)
    return out


def first_last(numbers: Column) -> tuple[Column, Column]:
    """Ages of a detail page."""
    return F.get(numbers, F.lit(0)), F.try_element_at(numbers, F.lit(-1))


def least_greatest(*numbers: Column) -> tuple[Column, Column]:
    """Ages of a list row, from several cells."""
    both = F.concat(*numbers)
    return F.array_min(both), F.array_max(both)


def find_first(sections: Column, labels: list[str], strip: bool = False) -> Column:
    """First value that isn't blank, section by section, label by label."""
    # of labels that meet after trimming the last one holds; a map can't be rebuilt from such keys
    trimmed = lambda s, x: F.get(F.reverse(F.filter(F.map_entries(s), lambda e: F.trim(e["key"]) == x)), F.lit(0))["value"]
    value = lambda s, x: trimmed(s, F.lit(x)) if strip else F.try_element_at(s, F.lit(x))
    values = F.flatten(F.transform(F.map_values(sections), lambda s: F.array(*[value(s, x) for x in labels])))
    return F.get(F.filter(values, lambda x: x.isNotNull() & (F.trim(x) != "")), F.lit(0))


def tokens(details: Column) -> Column:
    return F.filter(F.transform(F.split(details, r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def label_values(parts: Column) -> Column:
    """Tokens folded into a map: one that ends in `:-` opens a label, later ones join its value."""
    start = F.struct(F.lit("").alias("label"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("m"))

    def step(acc: Column, x: Column) -> Column:
        label = F.trim(F.regexp_replace(x, ":-$", ""))
        opened = F.map_zip_with(acc["m"], F.create_map(label, F.lit("")), lambda k, a, b: F.coalesce(a, b))
        grown = F.map_zip_with(acc["m"], F.create_map(acc["label"], x), lambda k, a, b: F.when(b.isNull(), a).otherwise(F.concat_ws(" ", F.nullif(a, F.lit("")), b)))
        is_label = x.endswith(":-")
        return F.struct(F.when(is_label, label).otherwise(acc["label"]).alias("label"), F.when(is_label, opened).when(acc["label"] == "", acc["m"]).otherwise(grown).alias("m"))

    tidy = lambda v: F.regexp_replace(F.regexp_replace(v, r"(?U)\s+", " "), r"^[, ]+|[, ]+$", "")
    return F.transform_values(F.aggregate(parts, start, step)["m"], lambda k, v: tidy(v))


def preamble(parts: Column) -> Column:
    """Tokens before the first label."""
    first = F.array_position(F.transform(parts, lambda x: x.endswith(":-")), True)
    return F.when(first == 0, parts).otherwise(F.slice(parts, F.lit(1), F.greatest(F.lit(0), (first - 1).cast("int"))))


def disaster_tag(parts: Column) -> Column:
    return F.coalesce(F.get(F.filter(parts, lambda x: ~x.rlike("^[०-९0-9]+$")), F.lit(0)), F.lit(""))


def list_date(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"(?U)(\d{4}-\d{2}-\d{2})", 1)


def list_record_id(page: Column, image: Column) -> Column:
    index = F.coalesce(F.nullif(F.regexp_extract(image, r"_i(\d+)\.jpg$", 1), F.lit("")), F.lit("0"))
    return F.concat(F.lit("PM-LIST-p"), page.cast("string"), F.lit("-i"), index)


def image_url(path: Column) -> Column:
    """Where the image is served; no path, no URL."""
    return F.concat(F.lit("/images/"), F.regexp_replace(F.nullif(path, F.lit("")), "^" + IMAGE_ROOT, ""))


def link_ids(html: Column, marker: str = "id=") -> Column:
    """Distinct numbers after `marker`, a regular expression."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(f"{marker}([0-9]+)"), F.lit(1)))


def normalize_ascii(c: Column) -> Column:
    """Punctuation and white space collapsed, lower case: exact for ASCII text."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[:.\-,।/|]+", " "), r"(?U)\s+", " ")))


_PUNCTUATION, _SPACE = re.compile(r"[:.\-,।/|]+"), re.compile(r"\s+")


def folded(s: pd.Series) -> pd.Series:
    return s.map(lambda x: _SPACE.sub(" ", _PUNCTUATION.sub(" ", unicodedata.normalize("NFKC", x or ""))).strip().casefold())


def normalize_text(c: Column) -> Column:
    """Unicode NFKC and full case folding, which have no built-in; once for each record, never for a pair."""
    return F.pandas_udf(folded, T.StringType())(c)
