"""python -m linkforge COMMAND ...: the batch jobs over files."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .functions.dates import stored_or_normalized
from .functions.images import clean_images
from .functions.text import normalize_text
from .operators import enrich, evaluate, pairs
from .schema import EMBEDDING_SUMMARY, GROUND_TRUTH, SIDECAR, VECTOR, conform
from .sources import paged
from .sources import tables as S


def registry(spark: SparkSession, path: str, summary: str | None, vectors: str | None):
    """Records in file order with event day, enrichment and vector."""
    d = S.read_registry(spark, path).withColumn("pos", F.monotonically_increasing_id())
    first = W.partitionBy("record_id").orderBy("pos")
    d = d.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
    d = stored_or_normalized(d)
    known = S.read_table(spark, summary, EMBEDDING_SUMMARY) if summary else spark.createDataFrame([], EMBEDDING_SUMMARY)
    d = enrich.enrich(d, known)
    found = S.read_table(spark, vectors, VECTOR) if vectors else spark.createDataFrame([], VECTOR)
    return d.join(enrich.usable_vectors(known, found), "record_id", "left")


def build_embeddings(spark: SparkSession, a: argparse.Namespace) -> None:
    """`out`/summary and `out`/vectors of every record: what the cache still holds, and what its image gives now."""
    manifest = S.read_registry(spark, a.registry).select("record_id", "image_path")
    if a.limit:
        manifest = manifest.orderBy("record_id").limit(a.limit)
    images = S.read_images(spark, a.images)
    cache = S.read_table(spark, f"{a.cache}/summary" if a.cache else "", SIDECAR) if a.cache else spark.createDataFrame([], SIDECAR)
    old = S.read_table(spark, f"{a.cache}/vectors", VECTOR) if a.cache else spark.createDataFrame([], VECTOR)
    cache = cache.drop("vector_exists").join(old.select("record_id", F.lit(True).alias("vector_exists")), "record_id", "left").fillna(False, ["vector_exists"])
    gate = {"min_size": a.min_face_size, "min_score": a.min_score, "min_blur": a.min_blur}
    summary = enrich.build_summary(manifest, images, enrich.whole_image_faces(images), cache, {k: v for k, v in gate.items() if v is not None}, a.force)
    todo = images.join(summary.where("usable and not reused"), "record_id", "left_semi")
    vectors = enrich.refreshed_vectors(summary, old, enrich.encode(todo, enrich.digest_encoder))
    S.write_registry(vectors, f"{a.out}/vectors")
    S.write_registry(S.merge_summary(cache.drop("vector_exists"), conform(summary.withColumn("record_type", F.lit(a.record_type)), SIDECAR).drop("vector_exists")), f"{a.out}/summary")
    n = enrich.run_counts(summary).first()
    print(f"[{a.record_type}] {n['usable']}/{n['records']} usable faces ({n['reused']} reused from cache)")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="linkforge")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *paths: str):
        c = sub.add_parser(name)
        for x in paths:
            c.add_argument(x)
        c.add_argument("--out", required=True)
        return c

    c = command("list-pages", "url", "marker")
    c.add_argument("--pages", type=int, help="their number, if the first page doesn't say it")
    c.add_argument("--delay", type=float, default=0.5)
    c.add_argument("--limit", type=int)
    command("clean-images", "images")
    command("import-list", "rows")
    command("import-details", "details").add_argument("--record-type", choices=["AM", "PM"], default="AM")
    command("normalize-dates", "registry")
    command("backfill-location", "registry", "details")
    b = command("build-embeddings", "registry", "images")
    b.add_argument("--limit", type=int)
    b.add_argument("--cache", help="the output folder of an earlier run: its summary and vectors")
    b.add_argument("--record-type", choices=["am", "pm"], default="am")
    b.add_argument("--force", action="store_true", help="reuse nothing")
    for gate in ("face-size", "score", "blur"):
        b.add_argument(f"--min-{gate}", type=float)
    command("build-index", "summary", "vectors")
    for name in ("search", "compare", "evaluate"):
        c = command(name, "am", "pm")
        for side in ("am", "pm"):
            c.add_argument(f"--{side}-summary")
            c.add_argument(f"--{side}-vectors")
        c.add_argument("--top-k", type=int, default=10 if name == "compare" else 20)
        c.add_argument("--first-stage", default="all")
        c.add_argument("--face-weight", type=float, default=0.6)
        c.add_argument("--min-score", type=float, default=0.0)
        c.add_argument("--record-types", choices=["am", "pm", "both"], default="both")
        c.add_argument("--truth")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("linkforge").getOrCreate()
    if a.command == "list-pages":
        spark.dataSource.register(paged.PagedList)
        pages = spark.read.format("paged_list").option("url", a.url).option("delay", a.delay)
        S.write_csv(paged.listed((pages if a.pages is None else pages.option("pages", a.pages)).load(), a.marker, a.limit), a.out)
    elif a.command == "clean-images":
        S.write_registry(clean_images(S.read_images(spark, a.images)), a.out)
    elif a.command == "import-list":
        S.write_registry(S.import_list(S.read_list_rows(spark, a.rows)), a.out)
    elif a.command == "import-details":
        S.write_registry(S.import_details(S.read_details(spark, a.details), a.record_type), a.out)
    elif a.command == "normalize-dates":
        S.write_registry(S.backfill_dates(S.read_registry(spark, a.registry)), a.out)
    elif a.command == "backfill-location":
        S.write_registry(S.backfill_location(S.read_registry(spark, a.registry), S.read_details(spark, a.details), S.PLACES), a.out)
    elif a.command == "build-embeddings":
        build_embeddings(spark, a)
    elif a.command == "build-index":
        S.write_index(enrich.usable_vectors(S.read_table(spark, a.summary, EMBEDDING_SUMMARY), S.read_table(spark, a.vectors, VECTOR)), a.out)
    else:
        am, pm = (pairs.prepare(registry(spark, path, s, v), normalize_text) for path, s, v in ((a.am, a.am_summary, a.am_vectors), (a.pm, a.pm_summary, a.pm_vectors)))
        if a.command == "compare":
            S.write_csv(pairs.metadata_search(am, pm, a.top_k, a.min_score), a.out)
            return
        sides = ["am", "pm"] if a.record_types == "both" else [a.record_types]
        found = pairs.search(am, pm, "both" if len(sides) > 1 else sides[0], a.top_k, a.first_stage, a.face_weight)
        if a.command == "search":
            S.write_candidates(found, a.out)
        else:
            truth = S.read_table(spark, a.truth, GROUND_TRUTH)
            S.write_report(evaluate.metrics(evaluate.truth_ranks(truth, found)).first().asDict(), a.out)


if __name__ == "__main__":
    main()
