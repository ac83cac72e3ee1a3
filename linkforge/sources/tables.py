"""Sources and sinks of the registries, side tables and images."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser
from pathlib import Path

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..functions.dates import normalize_dates
from ..schema import CSV, DETAIL_JSON, LIST_ROW, PERSON, SIDECAR, conform, nulls


def read_table(spark: SparkSession, path: str, schema: T.StructType, form: str | None = None) -> DataFrame:
    """CSV or Parquet with the given schema, absent columns as NULL; a missing path is an empty table."""
    form = form or ("csv" if path.endswith(".csv") else "parquet")
    reader = spark.read.options(**CSV) if form == "csv" else spark.read
    try:
        raw = reader.csv(path) if form == "csv" else reader.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return conform(nulls(raw), schema)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, PERSON)


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """JSON sidecars; unreadable ones, which lack the image's digest, are cache misses and left out."""
    raw = spark.read.option("wholetext", True).text(path).select(F.from_json("value", SIDECAR).alias("s")).select("s.*")
    return raw.where("image_sha256 is not null")


def read_details(spark: SparkSession, path: str) -> DataFrame:
    """record_id (from the file's name), name, sections of raw detail pages."""
    raw = spark.read.option("wholetext", True).text(path).withColumn("record_id", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1))
    return raw.select("record_id", F.from_json("value", DETAIL_JSON).alias("d")).select("record_id", "d.name", "d.sections")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """record_id, content, image_sha256 of image files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("record_id"), "content", F.sha2("content", 256).alias("image_sha256"))


def read_list_rows(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, LIST_ROW, "csv")


def write_registry(df: DataFrame, path: str, mode: str = "error") -> None:
    """A new path, never the one that `df` reads."""
    df.write.mode(mode).parquet(path)


def write_candidates(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("query_type").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**CSV).csv(path)


def write_index(vectors: DataFrame, path: str) -> None:
    """The gallery with its positions; an empty one is an error."""
    if vectors.isEmpty():
        raise ValueError("no usable vectors to index")
    vectors.write.mode("overwrite").parquet(path)


def append_registry(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def merge_summary(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of this run, and the old ones of records that it did not touch."""
    return new.unionByName(old.join(new.select("record_id"), "record_id", "left_anti"))


def write_report(values: dict, path: str) -> None:
    """A few collected metrics as JSON and Markdown."""
    Path(path).with_suffix(".json").write_text(json.dumps(values, indent=2, sort_keys=True))
    Path(path).with_suffix(".md").write_text("\n".join(["# Evaluation", "", *[f"- {k}: {v}" for k, v in sorted(values.items())], ""]))


# ------------------------------------------------------------------ page parsers


class _Element:
    def __init__(self, tag: str, css: tuple[str, ...] = (), parent: _Element | None = None):
        self.tag, self.css, self.parent, self.inside = tag, css, parent, []

    def elements(self) -> Iterator[_Element]:
        """All elements below, in the order of the page."""
        todo = [x for x in reversed(self.inside) if isinstance(x, _Element)]
        while todo:
            one = todo.pop()
            yield one
            todo += [x for x in reversed(one.inside) if isinstance(x, _Element)]

    def text(self) -> str:
        """Its words, without scripts and styles."""
        out, todo = [], list(reversed(self.inside))
        while todo:
            one = todo.pop()
            if isinstance(one, str):
                out.append(one)
            elif one.tag not in ("script", "style"):
                todo += reversed(one.inside)
        return " ".join("".join(out).split())


class _Page(HTMLParser):
    """The page as a tree: an end tag closes the nearest open element of its name and what is open in it."""

    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Element("")

    def handle_starttag(self, tag, attrs):
        one = _Element(tag, tuple((dict(attrs).get("class") or "").split()), self.at)
        self.at.inside.append(one)
        if tag not in self.VOID:
            self.at = one

    def handle_endtag(self, tag):
        one = self.at
        while one is not None and one.tag != tag:
            one = one.parent
        if one is not None and one.parent is not None:
            self.at = one.parent

    def handle_data(self, data):
        self.at.inside.append(data)


def _card(title: _Element) -> _Element:
    """The card's body around a title, else the title's parent."""
    around = title.parent
    while around is not None and not (around.tag == "div" and "card-body" in around.css):
        around = around.parent
    return around or title.parent


def _value(bold: _Element, label: str) -> str:
    """What stands for a bold label: the first span after it among its siblings, else what its parent's text adds to it."""
    after = bold.parent.inside[bold.parent.inside.index(bold) + 1 :]
    span = next((x for x in after if isinstance(x, _Element) and x.tag == "span"), None)
    return bold.parent.text()[len(label) :].lstrip(": ").strip() if span is None else span.text()


def page_sections(html: str) -> tuple[str, dict[str, dict[str, str]]]:
    """The first heading, and for each card of the page its labels and values."""
    page = _Page()
    page.feed(html)
    page.close()
    name, sections = None, {}
    for one in page.root.elements():
        if name is None and one.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            name = one.text()
        if "card-title" in one.css:
            bold = [(x, x.text().rstrip(":").strip()) for x in _card(one).elements() if x.tag == "strong"]
            sections[one.text()] = {label: _value(x, label) for x, label in bold if label}
    return name or "", sections


def html_sections(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, name, sections of detail pages: no built-in parses HTML, so batches go through the standard parser."""
    kind = dict(pages.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, sections = [], []
            for page in batch[html]:
                name, found = page_sections(page or "")
                names.append(name)
                sections.append(found)
            yield pd.DataFrame({key: batch[key], "name": names, "sections": sections})

    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, name string, sections map<string, map<string, string>>")


# ----------------------------------------------------------------- record builders


def import_list(rows: DataFrame) -> DataFrame:
    """PM records from list rows: labels, ages, date, tag and id out of the token stream."""
    d = rows.withColumn("parts", text.tokens(F.col("Details"))).withColumn("m", text.label_values(F.col("parts")))
    get = lambda label: F.nullif(F.try_element_at("m", F.lit(label)), F.lit(""))
    low, high = text.least_greatest(text.all_numbers(get("उमेर")), text.all_numbers(get("अनुमानित उमेर")))
    return d.select(
        text.list_record_id(F.col("Page"), F.col("Image_Filename")).alias("record_id"), F.lit("PM").alias("record_type"), F.nullif(get("नाम"), F.lit(text.UNIDENTIFIED)).alias("name"),
        text.canonical_sex(get("लिङ्ग")).alias("sex"), low.alias("age_min"), high.alias("age_max"), text.height_to_cm(get("उचाइ")).alias("height_cm"),
        F.nullif(text.list_date(F.col("Details")), F.lit("")).alias("event_date"), text.disaster_tag(text.preamble(F.col("parts"))).alias("disaster_tag"),
    )


# Labels of the detail pages, the ones that the portal shows first.
PLACES = {"province": ["प्रदेश"], "district": ["जिल्ला"], "municipality": ["गाउँपालिका / नगरपालिका"]}
LABELS = {
    "sex": ["लिङ्ग"],
    "age": ["उमेर /अन्दाजी उमेर", "उमेर"],
    "height": ["उचाई"],
    "event_date": {"AM": ["हराएको मिति"], "PM": ["भेटिएको मिति"]},
    "ward": ["वार्ड नम्बर"],
    "clothing": ["लगाएको लुगा"],
    "marks": ["विशेष चिन्ह", "विशिष्ट लक्षणहरु"],
}


def import_details(details: DataFrame, record_type: str) -> DataFrame:
    """Registry records from raw detail pages, dates normalised; PM pages carry no name of the person."""
    find = lambda names: text.clean(text.find_first(F.col("sections"), names, strip=True))
    known = lambda c: F.nullif(c, F.lit(""))
    low, high = text.first_last(text.all_numbers(find(LABELS["age"])))
    places = {c: known(find(names)) for c, names in PLACES.items()}
    out = conform(
        details.select(
            "record_id", F.lit(record_type).alias("record_type"), (F.lit(None).cast("string") if record_type == "PM" else known(text.clean(F.col("name")))).alias("name"), known(text.canonical_sex(find(LABELS["sex"]))).alias("sex"),
            low.alias("age_min"), high.alias("age_max"), text.height_to_cm(known(find(LABELS["height"]))).alias("height_cm"), known(find(LABELS["event_date"][record_type])).alias("event_date"),
            known(F.concat_ws(" ", *places.values())).alias("location"), *[c.alias(n) for n, c in places.items()], known(find(LABELS["ward"])).alias("ward"), known(find(LABELS["clothing"])).alias("clothing"), known(find(LABELS["marks"])).alias("distinguishing_marks"),
        ),
        PERSON,
    )
    return conform(backfill_dates(out), PERSON)


def import_coverage(registry: DataFrame) -> DataFrame:
    """How many imported records have a date, an age, a location and an image."""
    return registry.agg(F.count(F.lit(1)).alias("records"), F.count("event_date").alias("dated"), F.count("age_min").alias("aged"), F.count("location").alias("located"), F.count("image_path").alias("pictured"))


def backfill_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Records whose location changed, and those still without one."""
    old = before.select("record_id", F.col("location").alias("_old"))
    return after.join(old, "record_id").agg(F.count_if(~F.col("location").eqNullSafe(F.col("_old"))).alias("updated"), F.count_if(F.col("location").isNull()).alias("still_blank"))


def backfill_location(registry: DataFrame, details: DataFrame, labels: dict[str, list[str]]) -> DataFrame:
    """Location parts from raw details where there are any; without a detail page a record stays as it is."""
    found = details.select("record_id", *[text.find_first(F.col("sections"), names, strip=True).alias(f"_{c}") for c, names in labels.items()])
    d = registry.join(found, "record_id", "left")
    joined = F.nullif(F.concat_ws(" ", *[F.nullif(F.trim(F.col(f"_{c}")), F.lit("")) for c in labels]), F.lit(""))
    d = d.withColumn("location", F.coalesce(joined, "location"))
    return d.withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in labels}).drop(*[f"_{c}" for c in labels])


def backfill_dates(registry: DataFrame) -> DataFrame:
    """raw_event_date, calendar_type and event_date_normalized for every record; a second run changes nothing."""
    return normalize_dates(registry.drop("calendar_type", "event_date_normalized").withColumn("raw_event_date", F.col("event_date")))
