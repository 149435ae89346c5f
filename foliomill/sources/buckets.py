"""A Parquet table in buckets of a key, of which a batch rewrites only those that it touches.

Below the root, ``batch=N/bucket=B`` holds a bucket as batch N left it, and ``commits/N`` says for each bucket which batch left it last. A batch counts from the
moment its commit is there, which is renamed into place in one step; files of a batch that broke off are not read, and are written over when it comes again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class BucketTable:
    def __init__(self, spark: SparkSession, root: str, key: str, buckets: int):
        self.spark, self.root, self.key, self.buckets = spark, root, key, buckets
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def commits(self) -> list[int]:
        folder = self._path(f"{self.root}/commits")
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)] if self.fs.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def left_by(self, number: int | None) -> dict[int, int]:
        """For each bucket that has rows, the batch that left it last, as of a commit; at most ``buckets`` numbers."""
        if number is None:
            return {}
        lines = self.spark.read.text(f"{self.root}/commits/{number}").collect()
        return {int(b): int(n) for b, n in (r[0].split() for r in lines if r[0])}

    def rows(self, left_by: dict[int, int], schema: str) -> DataFrame:
        paths = [f"{self.root}/batch={n}/bucket={b}" for b, n in sorted(left_by.items())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, schema: str, number: int | None = None) -> DataFrame:
        """The table as of a commit, by default the last."""
        done = self.commits()
        return self.rows(self.left_by(number if number is not None else (done[-1] if done else None)), schema)

    def merge(self, number: int, batch: DataFrame, fold: Callable[[DataFrame], DataFrame]) -> None:
        """Fold the rows of a batch, together with the rows of their buckets, and commit. Batches come in order; one that is committed is left alone."""
        done = self.commits()
        if number in done:
            return
        before = self.left_by(max((n for n in done if n < number), default=None))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema)
        touched = [r[0] for r in batch.select(self.bucket()).distinct().collect()]  # at most ``buckets`` numbers
        if touched:
            both = batch.unionByName(self.rows({b: n for b, n in before.items() if b in set(touched)}, schema))
            folded = fold(both).withColumn("bucket", self.bucket())
            folded.repartition(min(len(touched), 200), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/batch={number}")
        self.commit(number, before | dict.fromkeys(touched, number))

    def commit(self, number: int, left_by: dict[int, int]) -> None:
        text = "".join(f"{b} {n}\n" for b, n in sorted(left_by.items()))
        draft, place = self._path(f"{self.root}/commits/_{number}"), self._path(f"{self.root}/commits/{number}")
        out = self.fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self.fs.rename(draft, place):
            raise RuntimeError(f"commit {number} could not be put into place")

    def forget(self, keep: int = 2) -> None:
        """Delete the commits before the last ``keep``, and the buckets that none of these reads."""
        done = self.commits()
        wanted = {f"batch={n}/bucket={b}" for c in done[-keep:] for b, n in self.left_by(c).items()}
        for n in range(done[-1] + 1) if done else ():
            folder = self._path(f"{self.root}/batch={n}")
            for s in self.fs.listStatus(folder) if self.fs.exists(folder) else ():
                if f"batch={n}/{s.getPath().getName()}" not in wanted:
                    self.fs.delete(s.getPath(), True)
        for n in done[:-keep]:
            self.fs.delete(self._path(f"{self.root}/commits/{n}"), False)
