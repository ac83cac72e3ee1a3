"""A registry as committed versions: data folders are written once, and a numbered manifest says which of them are the registry.

    root/data/<name>/     Parquet, never changed
    root/commits/<n>.json {"folders": [...], "runs": [...]}

Readers take the newest manifest and its folders, so they see one version whole, whatever is written meanwhile. A manifest appears by a rename that fails if
its number is taken, so of two writers one has to begin anew. What a crash leaves behind is a folder that no manifest names, which `vacuum` deletes.
A rewrite may read the version that it replaces. An append carries a run's name; a run that is in already adds nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..shared import file_system


class Conflict(RuntimeError):
    """Another writer committed first."""


@dataclass
class Versions:
    spark: SparkSession
    root: str

    def _list(self, folder: str) -> list[str]:
        path, fs = file_system(self.spark, f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def numbers(self) -> list[int]:
        return sorted(int(x[:-5]) for x in self._list("commits") if x.endswith(".json"))

    def manifest(self, number: int | None = None) -> dict:
        """The newest manifest, or one by its number; before the first an empty one."""
        have = self.numbers()
        if not have:
            return {"number": 0, "folders": [], "runs": []}
        number = have[-1] if number is None else number
        path, fs = file_system(self.spark, f"{self.root}/commits/{number:08d}.json")
        stream = fs.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) | {"number": number}

    def read(self, schema: T.StructType | str, number: int | None = None) -> DataFrame:
        """The rows of one version with `commit`, the place of their folder in it."""
        folders, out = self.manifest(number)["folders"], None
        for k, name in enumerate(folders):
            one = self.spark.read.schema(schema).parquet(f"{self.root}/data/{name}").withColumn("commit", F.lit(k).cast("long"))
            out = one if out is None else out.unionByName(one)
        return self.spark.createDataFrame([], schema).withColumn("commit", F.lit(None).cast("long")) if out is None else out

    def newest(self, schema: T.StructType | str, key: str | list[str] = "record_id") -> DataFrame:
        """One row for each key, of one or more columns: of the latest commit, and in it the first by its other columns."""
        rows, keys = self.read(schema), [key] if isinstance(key, str) else list(key)
        order = [F.desc("commit"), *[F.asc(c) for c, kind in rows.dtypes if c not in ("commit", *keys) and not kind.startswith("map")]]
        best = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
        return rows.withColumn("_n", best).where("_n = 1").drop("_n", "commit")

    def _commit(self, before: dict, folders: list[str], run: str) -> int:
        number = before["number"] + 1
        jvm = self.spark._jvm
        draft, fs = file_system(self.spark, f"{self.root}/commits/.{uuid.uuid4().hex}")
        target, _ = file_system(self.spark, f"{self.root}/commits/{number:08d}.json")
        stream = fs.create(draft)
        stream.write(bytearray(json.dumps({"folders": folders, "runs": [*before["runs"], run]}).encode()))
        stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(draft, target, plain)
        except Exception as e:
            fs.delete(draft, False)
            if fs.exists(target):
                raise Conflict(f"version {number} is there already") from e
            raise
        return number

    def _write(self, df: DataFrame) -> str:
        name = uuid.uuid4().hex
        df.drop("commit").write.parquet(f"{self.root}/data/{name}")
        return name

    def rewrite(self, df: DataFrame, run: str) -> int:
        """`df` becomes the registry; it may read the version before."""
        before = self.manifest()
        return self._commit(before, [self._write(df)], run)

    def append(self, df: DataFrame, run: str) -> int | None:
        """The number of the new version, or None if the run is in already."""
        before = self.manifest()
        if run in before["runs"]:
            return None
        return self._commit(before, [*before["folders"], self._write(df)], run)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes manifests but for the last `keep`, and the folders that the rest don't name. No writer may be at work."""
        have = self.numbers()
        for n in have[:-keep]:
            path, fs = file_system(self.spark, f"{self.root}/commits/{n:08d}.json")
            fs.delete(path, False)
        named = {f for n in have[-keep:] for f in self.manifest(n)["folders"]}
        gone = [f for f in self._list("data") if f not in named]
        for f in gone:
            path, fs = file_system(self.spark, f"{self.root}/data/{f}")
            fs.delete(path, True)
        return gone
