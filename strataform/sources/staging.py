"""Tables in the folder that driver and executors share: saved steps, and a table of versions with manifests."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only a local session without that setting gets a temporary folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="strataform-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def saved(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that its plan ends there; by: columns whose values are folders."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Versions:
    """A table whose rows lie in parts, and whose versions are manifests that list parts.

    A save writes its part first and then one manifest, which must not exist yet: whoever
    reads sees the old version or the new one, never half of it. Parts of saves that
    failed are in no manifest. A batch that was saved before isn't saved again.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str) -> None:
        self.spark, self.folder, self.schema = spark, folder, schema

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def manifests(self) -> list[dict]:
        """All versions, oldest first."""
        files, path = self._path("manifests")
        if not files.exists(path):
            return []
        names = sorted(str(f.getPath()) for f in files.listStatus(path) if f.getPath().getName().endswith(".json"))
        read = self.spark.read.text(names, wholetext=True).collect() if names else []  # a row for each version
        return sorted((json.loads(r["value"]) for r in read), key=lambda m: m["version"])

    def _commit(self, manifest: dict) -> int:
        files, path = self._path(f"manifests/{manifest['version']:010d}.json")
        out = files.create(path, False)  # fails if another save made this version
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        return manifest["version"]

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last one by default."""
        found = [m for m in self.manifests() if version is None or m["version"] == version]
        parts = found[-1]["parts"] if found else []
        return self.spark.read.schema(self.schema).parquet(*parts) if parts else self.spark.createDataFrame([], self.schema)

    def save(self, df: DataFrame, batch: str | int | None = None, replace: bool = False) -> int:
        """Add rows, or replace all, as a new version; the version that already has the batch, if one does."""
        known = self.manifests()
        for m in known:
            if batch is not None and m["batch"] == str(batch):
                return m["version"]
        part = f"{self.folder}/parts/{uuid.uuid4().hex}"
        df.write.parquet(part)  # an error here leaves no manifest
        before = [] if replace or not known else known[-1]["parts"]
        return self._commit({"version": known[-1]["version"] + 1 if known else 1, "parts": [*before, part], "batch": None if batch is None else str(batch), "part": part})

    def undo(self, version: int) -> int:
        """A new version without the part that the given one added; what came after it stays."""
        known = self.manifests()
        gone = next(m["part"] for m in known if m["version"] == version)
        return self._commit({"version": known[-1]["version"] + 1, "parts": [p for p in known[-1]["parts"] if p != gone], "batch": None, "part": None})

    def save_each(self, batches: list[tuple[str, DataFrame]]) -> dict:
        """Save one batch after another until one fails: {saved, failed, left, error}. What was saved stays."""
        done: list[str] = []
        for k, (name, df) in enumerate(batches):
            try:
                self.save(df, name)
            except Exception as error:  # reported, not raised: the caller decides whether to undo
                return {"saved": done, "failed": name, "left": [n for n, _ in batches[k + 1 :]], "error": str(error).splitlines()[0]}
            done.append(name)
        return {"saved": done, "failed": None, "left": [], "error": None}

    def undo_batches(self, names: list[str]) -> None:
        """Take back the batches of these names, the last one first."""
        for m in reversed(self.manifests()):
            if m["batch"] in names:
                self.undo(m["version"])

    def sink(self, made: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: a batch that is replayed after a restart changes nothing."""
        return lambda df, number: None if self.save(made(df), f"stream-{number}") else None
