"""Products that grow by versions: immutable parts, a manifest per commit, and only new scenes to prepare.

A store is a folder with parts (rows of scenes, Parquet) and manifests `commit-<n>.json`, which list the parts and what scenes each
holds at that version. A commit writes its part first and then claims its number by a rename that fails if another writer has it,
so a reader sees all of a commit or nothing. A scene's rows are those of its last version; nothing is overwritten.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has committed since the store was read; its commit stands, and this one may be tried again."""


class Store:
    """rows(scene, ...): `scene` are the columns that tell scenes apart, and rows of a scene are replaced together."""

    def __init__(self, spark: SparkSession, path: str, scene: list[str]):
        self.spark, self.path, self.scene = spark, path.rstrip("/"), scene
        jvm = spark._jvm
        self._of = jvm.org.apache.hadoop.fs.Path
        self._files = self._of(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        if not self._files.exists(self._of(self.path)):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._of(self.path))]
        return sorted(int(n[7:-5]) for n in names if n.startswith("commit-") and n.endswith(".json"))

    @property
    def version(self) -> int:
        """The last commit; 0 before the first."""
        return max(self._numbers(), default=0)

    def parts(self, version: int | None = None) -> list[str]:
        """The folders of a version's parts, oldest first."""
        version = self.version if version is None else version
        if not version:
            return []
        text = self.spark.read.text(f"{self.path}/commit-{version}.json", wholetext=True).first()[0]
        return json.loads(text)["parts"]

    def scenes(self, version: int | None = None) -> DataFrame | None:
        """(scene, part): the part that holds each scene's last version; None in an empty store."""
        parts = self.parts(version)
        if not parts:
            return None
        each = [self.spark.read.parquet(f"{self.path}/{p}/scenes").withColumn("_n", F.lit(n)) for n, p in enumerate(parts)]
        every = each[0]
        for e in each[1:]:
            every = every.unionByName(e)
        return every.groupBy(*self.scene).agg(F.max("_n").alias("part"))

    def read(self, version: int | None = None) -> DataFrame:
        """All rows at a version, the last by default."""
        parts = self.parts(version)
        if not parts:
            raise FileNotFoundError(f"no commit in {self.path}")
        last = self.scenes(version)
        rows = None
        for n, p in enumerate(parts):
            own = self.spark.read.parquet(f"{self.path}/{p}/rows").withColumn("part", F.lit(n))
            rows = own if rows is None else rows.unionByName(own)
        return rows.join(last, [*self.scene, "part"], "left_semi").drop("part") if len(parts) > 1 else rows.drop("part")

    def unseen(self, wanted: DataFrame) -> DataFrame:
        """Rows of wanted(scene, ...) whose scene no version holds."""
        held = self.scenes()
        return wanted if held is None else wanted.join(held.select(*self.scene), self.scene, "left_anti")

    def commit(self, rows: DataFrame, scenes: DataFrame | None = None, after: int | None = None) -> int:
        """Add rows as a new part and return its version; their scenes replace earlier versions. `scenes` adds scenes without rows.

        `after` is the version that the rows were made from; the last one by default. An empty part is committed like any other.
        """
        after = self.version if after is None else after
        part = f"part-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{part}/rows")
        own = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{part}/rows").select(*self.scene)
        (own.unionByName(scenes.select(*self.scene)) if scenes is not None else own).distinct().write.parquet(f"{self.path}/{part}/scenes")
        made, goal = self._of(f"{self.path}/.{part}.json"), self._of(f"{self.path}/commit-{after + 1}.json")
        out = self._files.create(made)
        out.write(bytearray(json.dumps({"parts": [*self.parts(after), part]}).encode()))
        out.close()
        if self._files.exists(goal) or not self._files.rename(made, goal):
            self._files.delete(made, False)
            raise Conflict(f"version {after + 1} of {self.path} is taken")
        return after + 1
