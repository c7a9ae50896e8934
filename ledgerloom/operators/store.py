"""An append-only store: each commit writes new Parquet folders and then one manifest that names them.

Readers see whole manifests only, so a commit is whole or not there.  A version's manifest is made under another name and
then takes its own, which fails where a writer was faster: that commit takes the next version, or is refused if it was to
follow a certain one.  Nothing is rewritten: a reversal, a rolled-back import or a new category is a further delta, and the
current state a view.
"""

from __future__ import annotations

import json
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Conflict(Exception):
    """Another commit came between the version that a commit was to follow and itself."""


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._manifest = self._path(f"{self.root}/manifest")
        self._files = self._manifest.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _manifests(self) -> DataFrame | None:
        """All manifests; None in a store without a commit."""
        if not self.version():
            return None
        return self.spark.read.schema("version long, table string, folder string").json(f"{self.root}/manifest")

    def version(self) -> int:
        if not self._files.exists(self._manifest):
            return 0
        names = (f.getPath().getName() for f in self._files.listStatus(self._manifest))
        return max((int(m[1]) for n in names if (m := re.fullmatch(r"v(\d+)\.json", n))), default=0)

    def _claimed(self, version: int, lines: str) -> bool:
        """Whether the manifest of ``version`` could be made; false where there is one."""
        draft, final = self._path(f"{self.root}/manifest/.draft-{uuid.uuid4().hex}"), self._path(f"{self.root}/manifest/v{version:012d}.json")
        out = self._files.create(draft, True)
        out.write(lines.encode())
        out.close()
        try:
            if self._files.getScheme() == "file":  # a link is made or not, and never over another; renames of local files do replace
                local = lambda p: self._jvm.java.nio.file.Paths.get(self._files.makeQualified(p).toUri())
                self._jvm.java.nio.file.Files.createLink(local(final), local(draft))
                self._files.delete(draft, False)
            else:
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._manifest.toUri(), self.spark._jsc.hadoopConfiguration())
                context.rename(draft, final, self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
            return True
        except Py4JJavaError as e:
            self._files.delete(draft, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise

    def commit(self, deltas: dict[str, DataFrame], follows: int | None = None) -> int:
        """Append rows to tables; all of them become visible at once, as the new version.

        With ``follows`` the commit stands only if that version is still the newest, as where its rows were checked against it.
        """
        folders = {}
        for name, df in deltas.items():
            folders[name] = f"{self.root}/data/{name}/{uuid.uuid4().hex}"
            df.write.parquet(folders[name])
        while True:
            version = self.version() + 1
            lines = "".join(json.dumps({"version": version, "table": n, "folder": f}) + "\n" for n, f in folders.items())
            if follows is None and self._claimed(version, lines):
                return version
            if follows is not None:
                if version == follows + 1 and self._claimed(version, lines):
                    return version
                for folder in folders.values():
                    self._files.delete(self._path(folder), True)
                raise Conflict(f"version {follows} is not the newest any more")

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """All rows of a table up to a version, each with the version that brought it; one scan, however many commits there are."""
        held = self._manifests()
        known = [] if held is None else [(r["folder"], r["version"]) for r in held.filter(F.col("table") == name).collect() if version is None or r["version"] <= version]
        if not known:
            raise KeyError(f"no table {name}")
        rows = self.spark.read.option("mergeSchema", True).parquet(*(f for f, _ in known))
        commits = self.spark.createDataFrame([(f.rpartition("/")[2], v) for f, v in known], "folder string, version long")
        named = rows.withColumn("folder", F.regexp_extract(F.col("_metadata.file_path"), "/([0-9a-f]{32})/[^/]*$", 1))
        return named.join(commits, "folder").drop("folder").select(*rows.columns, F.col("version").cast("int").alias("version"))

    def latest(self, name: str, key: list[str]) -> DataFrame:
        """Upserts: of the rows of one key, those of the newest version; a row with ``deleted`` true removes its key."""
        newest = Window.partitionBy(*key).orderBy(F.desc("version"))
        rows = self.read(name).withColumn("nth", F.row_number().over(newest)).filter("nth = 1").drop("nth")
        return rows.filter(~F.coalesce(F.col("deleted"), F.lit(False))).drop("deleted") if "deleted" in rows.columns else rows


def insert_or_get(existing: DataFrame, names: DataFrame) -> DataFrame:
    """(name, id) of each asked name: that of the row whose name is the same but for case, else a new one from the name."""
    held = existing.groupBy(F.lower("name").alias("folded")).agg(F.min("id").alias("id"))
    asked = names.select(F.trim("name").alias("name")).filter("name <> ''").withColumn("folded", F.lower("name")).dropDuplicates(["folded"])
    return asked.join(held, "folded", "left").select("name", F.coalesce("id", F.sha2("folded", 256)).alias("id"), F.col("id").isNull().alias("is_new"))


def set_tags(current: DataFrame, replaced: DataFrame) -> DataFrame:
    """(transaction_id, tag) after the tags of ``replaced``'s transactions have been replaced; a null tag clears."""
    keep = current.join(replaced.select("transaction_id").distinct(), "transaction_id", "left_anti").select("transaction_id", "tag")
    return keep.unionByName(replaced.filter("tag is not null").select("transaction_id", "tag").distinct())
