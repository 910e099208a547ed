"""Tables published whole: a version is staged, checked, and then named by a pointer that readers follow."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Refused(ValueError):
    """A staged version failed its checks; what readers see has not changed."""


class Pointer:
    """Numbered small files in a folder, each written once by renaming: the highest one is what holds."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def last(self) -> int | None:
        """The highest number; None if nothing was published."""
        folder = self._at("pointer")
        if not self._fs.exists(folder):
            return None
        numbers = [int(x.getPath().getName()) for x in self._fs.listStatus(folder) if x.getPath().getName().isdigit()]
        return max(numbers, default=None)

    def read(self) -> dict | None:
        n = self.last()
        if n is None:
            return None
        stream = self._fs.open(self._at(f"pointer/{n}"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def write(self, n: int, value: dict) -> bool:
        """Publish ``value`` under a number; False if that number is taken."""
        made = self._at(f"pointer/.{n}-{uuid.uuid4().hex}")
        out = self._fs.create(made)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        if self._fs.exists(self._at(f"pointer/{n}")) or not self._fs.rename(made, self._at(f"pointer/{n}")):
            self._fs.delete(made, False)
            return False
        for old in range(max(0, n - 20), n - 1):  # the one before stays for readers that have just read it
            self._fs.delete(self._at(f"pointer/{old}"), False)
        return True

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def folders(self, name: str) -> list[str]:
        folder = self._at(name)
        return [x.getPath().getName() for x in self._fs.listStatus(folder)] if self._fs.exists(folder) else []


class Published:
    """A table at a path of which readers see one whole version or the next, never a part or a refused one."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.pointer = spark, path.rstrip("/"), Pointer(spark, path)

    def current(self) -> DataFrame | None:
        held = self.pointer.read()
        return held and self.spark.read.parquet(f"{self.path}/{held['version']}")

    def publish(self, df: DataFrame, checks: dict[str, Column]) -> DataFrame:
        """Stage ``df``, evaluate the checks (aggregates that must be true) on what was written, and point to it.

        A failed check deletes the staged version and raises Refused with the
        names of the failed ones; a check that is NULL has failed.
        """
        before = self.pointer.read()
        version = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{version}")
        staged = self.spark.read.parquet(f"{self.path}/{version}")
        held = staged.agg(*[F.coalesce(c, F.lit(False)).alias(name) for name, c in checks.items()]).first().asDict() if checks else {}
        failed = [name for name, good in held.items() if not good]
        n = (self.pointer.last() or 0) + 1
        if failed or not self.pointer.write(n, {"version": version, "before": before and before["version"]}):
            self.pointer.delete(version)
            raise Refused(", ".join(failed) or "another version was published meanwhile")
        if before and before.get("before"):
            self.pointer.delete(before["before"])  # two versions back: no reader starts on it any more
        return staged
