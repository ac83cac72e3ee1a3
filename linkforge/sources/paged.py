"""A paged list as a Spark data source: a partition is a range of pages, each fetched with retries.

    spark.dataSource.register(PagedList)
    pages = spark.read.format("paged_list").option("url", "https://host/list?page={page}").load()

Options: url with {page}; pages, their number, else what `count` finds in the first page (a pattern with one group), else 1; first (1);
attempts (3), delay (0.5 seconds, times the number of the attempt), timeout (30), per_partition (8 pages); agent, the name given to the host.
A page that can't be had after all attempts is a row with its error and no body, so that a later run can ask for it again. Addresses may be http, https or file.
"""

from __future__ import annotations

import re
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "page int, url string, body string, attempts int, error string"
#: What a list page says of their number.
COUNT = r"out of\s+(\d+)\s+Pages"
TAG = re.compile(r"<[^>]*>")


def fetch(url: str, attempts: int = 3, delay: float = 0.5, timeout: float = 30, agent: str = "linkforge") -> tuple[str | None, int, str | None]:
    """Body, attempts used and the last error; waits longer after each failure."""
    error = None
    for n in range(1, attempts + 1):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=timeout) as answer:
                if getattr(answer, "status", None) in (200, None):  # files have no status
                    return answer.read().decode("utf-8", "replace"), n, None
                error = f"status {answer.status}"
        except (OSError, ValueError) as e:  # URLError and time-outs are OSErrors
            error = f"status {e.code}" if isinstance(e, urllib.error.HTTPError) else f"{type(e).__name__}: {e}"[:200]
        if n < attempts:
            time.sleep(delay * n)
    return None, attempts, error


class Pages(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.url = options.get("url") or ""
        if "{page}" not in self.url:
            raise ValueError("option url has to hold {page}")
        self.number, self.count = options.get("pages"), options.get("count") or COUNT
        self.first, self.each = int(options.get("first") or 1), max(1, int(options.get("per_partition") or 8))
        self.asked = (int(options.get("attempts") or 3), float(options.get("delay") or 0.5), float(options.get("timeout") or 30), options.get("agent") or "linkforge")

    def partitions(self) -> list[Pages]:
        if self.number is not None:
            n = int(self.number)
        else:
            body, _, _ = fetch(self.url.format(page=self.first), *self.asked)
            found = re.search(self.count, TAG.sub(" ", body or ""))
            n = int(found.group(1)) if found else 1
        last = self.first + n - 1
        return [Pages(k, min(last, k + self.each - 1)) for k in range(self.first, last + 1, self.each)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        for page in range(partition.first, partition.last + 1):
            url = self.url.format(page=page)
            body, used, error = fetch(url, *self.asked)
            yield page, url, body, used, error


class PagedList(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_list"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))


def listed(pages: DataFrame, marker: str, limit: int | None = None, page: str = "page", body: str = "body", within: Column | None = None) -> DataFrame:
    """record_id, page, place of the ids that links hold after `marker`, each where it stands first; the first `limit` of them if asked.

    `marker` is plain text; `within` may give what to search instead of the links of `body`.
    """
    quoted = re.escape(marker)
    links = F.regexp_extract_all(F.col(body), F.lit(r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1)) if within is None else within
    d = pages.select(F.col(page).alias("page"), F.posexplode(links).alias("place", "link")).withColumn("record_id", F.regexp_extract("link", rf"{quoted}(\d+)", 1)).where("record_id <> ''")
    first = d.groupBy("record_id").agg(F.min(F.struct("page", "place")).alias("at")).select("record_id", "at.page", "at.place")
    return first if limit is None else first.orderBy("page", "place").limit(limit)
