"""Versioned state: each version is a directory of its own, and numbered commit files say which one is current."""

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Somebody else has committed since the state was read."""


class StateStore:
    """A table that is replaced as a whole: write a new version, then commit it under the next number.

    A commit file is created exclusively, so of two writers who read the same version one gets a :class:`Conflict`
    and no update is lost; :meth:`update` tries again. Readers never see half a version, the version being read is never
    overwritten, and a crash leaves the old one. Works on any file system of Hadoop that creates files exclusively.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def number(self) -> int:
        """Number of the current commit, 0 before the first."""
        log = self._Path(f"{self.path}/commits")
        if not self._fs.exists(log):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(log)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def current(self, number: int | None = None) -> str | None:
        """Directory of the current version (or of a commit), None before the first."""
        n = self.number() if number is None else number
        if n == 0:
            return None
        text = self.spark.read.text(f"{self.path}/commits/{n:012d}", wholetext=True).first()
        return f"{self.path}/{json.loads(text.value)['version']}"

    def read(self, schema: str) -> DataFrame:
        """The current version; before the first one an empty table of the schema."""
        return self._read(schema, self.number())

    def _read(self, schema: str, number: int) -> DataFrame:
        at = self.current(number)
        return self.spark.createDataFrame([], schema) if at is None else self.spark.read.schema(schema).parquet(at)

    def write(self, df: DataFrame, after: int | None = None) -> int:
        """Writes ``df`` as the version after commit ``after`` (the current one by default) and gives its number."""
        number, version = (self.number() if after is None else after) + 1, f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{version}")
        self._fs.mkdirs(self._Path(f"{self.path}/commits"))
        commit = self._Path(f"{self.path}/commits/{number:012d}")
        try:
            out = self._fs.create(commit, False)
        except Exception as e:
            self._fs.delete(self._Path(f"{self.path}/{version}"), True)
            raise Conflict(f"commit {number} exists") from e
        out.write(bytearray(json.dumps({"version": version}).encode()))
        out.close()
        return number

    def update(self, schema: str, change: Callable[[DataFrame], DataFrame], attempts: int = 5) -> int:
        """Reads, changes and writes the state; begins anew with what others have committed meanwhile."""
        for left in range(attempts - 1, -1, -1):
            n = self.number()
            try:
                return self.write(change(self._read(schema, n)), n)
            except Conflict:
                if not left:
                    raise
        raise ValueError("no attempts")
