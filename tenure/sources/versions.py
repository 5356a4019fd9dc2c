"""Stored tables in hash buckets, with versions: a change rewrites the buckets it touches and nothing else.

    <base>/data/v=<n>/bucket=<b>/...   the files that version n wrote
    <base>/schema/                     an empty file with the columns
    <base>/manifest/v=<n>/             (bucket, data): which data versions hold each bucket of version n

A version is its manifest, written after its data, so readers see a whole version or none; two writers of the
same version collide on its manifest folder. An update replaces the entries of the buckets it touches
(copy-on-write), an insert adds one. A version remembers the id of the batch that made it: a batch that comes
again changes nothing. A manifest has a row for each bucket and data version in use, never a row for each row.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.sources.tables import missing_path

_BUCKET = "bucket"


class BucketedTable:
    """A stored table of ``buckets`` hash buckets by ``keys``."""

    def __init__(self, spark: SparkSession, base: str, keys: list[str], buckets: int = 64) -> None:
        self.spark, self.base, self.keys, self.buckets = spark, base.rstrip("/"), keys, buckets

    def bucket_of(self, prefix: str = "") -> Column:
        return F.pmod(F.xxhash64(*[F.col(prefix + k) for k in self.keys]), F.lit(self.buckets)).cast("int")

    def version(self) -> int:
        """The newest version, -1 before the first; from file names alone."""
        try:
            files = self.spark.read.parquet(f"{self.base}/manifest").inputFiles()
        except AnalysisException as e:
            if not missing_path(e):
                raise
            return -1
        return max(int(m.group(1)) for f in files if (m := re.search(r"/v=(\d+)/", f)))

    def _entries(self, version: int) -> list[tuple[int, int]]:
        if version < 0:
            return []
        rows = self.spark.read.parquet(f"{self.base}/manifest/v={version}").select(_BUCKET, "data").collect()
        return sorted((r[_BUCKET], r["data"]) for r in rows if r[_BUCKET] is not None)

    def has_batch(self, batch: str) -> bool:
        return self.version() >= 0 and not self.spark.read.parquet(f"{self.base}/manifest").filter(F.col("batch") == batch).isEmpty()

    def batch_of(self, version: int) -> str | None:
        """The id of the batch that made a version."""
        return self.spark.read.parquet(f"{self.base}/manifest/v={version}").select("batch").first()[0]

    def differing(self, version: int, other: int) -> set[int]:
        """The buckets whose files are not the same in two versions; from the manifests alone."""
        return {b for b, _ in set(self._entries(version)) ^ set(self._entries(other))}

    def read(self, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """A version (the newest by default), or only some of its buckets: no other file is listed or read."""
        version = self.version() if version is None else version
        paths = [f"{self.base}/data/v={data}/{_BUCKET}={b}" for b, data in self._entries(version) if buckets is None or b in buckets]
        schema = self.spark.read.parquet(f"{self.base}/schema").schema
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, version: int) -> set[int]:
        """Write ``rows`` as data of ``version``; the buckets that got files."""
        path = f"{self.base}/data/v={version}"
        spread = rows.withColumn(_BUCKET, self.bucket_of()).repartition(self.buckets, _BUCKET)
        spread.sortWithinPartitions(*self.keys).write.mode("overwrite").partitionBy(_BUCKET).parquet(path)
        files = self.spark.read.parquet(path).inputFiles() if not rows.isEmpty() else []
        return {int(m.group(1)) for f in files if (m := re.search(rf"/{_BUCKET}=(\d+)/", f))}

    def _publish(self, version: int, entries: set[tuple[int, int]], batch: str | None) -> int:
        rows = [(b, d, batch) for b, d in sorted(entries)] or [(None, None, batch)]
        manifest = self.spark.createDataFrame(rows, f"{_BUCKET} int, data int, batch string")
        manifest.coalesce(1).write.mode("errorifexists").parquet(f"{self.base}/manifest/v={version}")
        return version

    def create(self, rows: DataFrame, batch: str | None = None) -> int:
        """Version 0."""
        if self.version() >= 0:
            raise FileExistsError(f"there is a table in {self.base}")
        self.spark.createDataFrame([], rows.schema).coalesce(1).write.mode("overwrite").parquet(f"{self.base}/schema")
        return self._publish(0, {(b, 0) for b in self._write(rows, 0)}, batch)

    def apply(self, changes: DataFrame, batch: str | None = None) -> int:
        """The version after ``changes`` (``operators.changes.changed_rows``): old rows go, new rows come.

        Only buckets that hold an old or new row are read and written. Rows are a multiset: one old row
        takes one equal row away.
        """
        now = self.version()
        if batch is not None and self.has_batch(batch):
            return now
        cols = [c.removeprefix("new_") for c in changes.columns if c.startswith("new_")]
        old = changes.filter("kind <> 'insert'").select(*[F.col(f"old_{c}").alias(c) for c in cols])
        new = changes.filter("kind <> 'delete'").select(*[F.col(f"new_{c}").alias(c) for c in cols])
        hit = {r[0] for r in old.select(self.bucket_of()).union(new.select(self.bucket_of())).distinct().collect()}  # at most ``buckets``
        if not hit:
            return self._publish(now + 1, set(self._entries(now)), batch)
        kept = self.read(now, hit).select(*cols).exceptAll(old)
        written = self._write(kept.unionByName(new), now + 1)
        entries = {(b, d) for b, d in self._entries(now) if b not in hit} | {(b, now + 1) for b in written}
        return self._publish(now + 1, entries, batch)

    def insert_if_absent(self, incoming: DataFrame, order: list[str] | None = None, batch: str | None = None) -> int:
        """``INSERT ... ON CONFLICT (keys) DO NOTHING``: the version with the rows whose keys are new.

        Of equal keys in the batch the first counts (by ``order``, else by the other columns). Only the keys of the
        buckets that the batch falls in are read; nothing is rewritten, the new rows are added as files.
        """
        now = self.version()
        if batch is not None and self.has_batch(batch):
            return now
        rest = [c for c in incoming.columns if c not in self.keys]
        rank = F.struct(*[F.col(c) for c in (order or rest or self.keys)])
        firsts = incoming.groupBy(*self.keys).agg(F.min_by(F.struct(*incoming.columns), rank).alias("row")).select("row.*")
        hit = {r[0] for r in firsts.select(self.bucket_of()).distinct().collect()}
        new = firsts.join(self.read(now, hit).select(*self.keys), self.keys, "left_anti")
        written = self._write(new, now + 1)
        return self._publish(now + 1, set(self._entries(now)) | {(b, now + 1) for b in written}, batch)

    def add(self, counts: list[str], delta: DataFrame | None, batch: str | None = None) -> int:
        """The version in which the ``counts`` of each row of ``delta`` are added to those of the row that is equal otherwise.

        Rows whose counts are all 0 then go. Only buckets that ``delta`` falls in are read and written.
        """
        now = self.version()
        if batch is not None and self.has_batch(batch):
            return now
        hit = set() if delta is None else {r[0] for r in delta.select(self.bucket_of()).distinct().collect()}
        if not hit:
            return self._publish(now + 1, set(self._entries(now)), batch)
        rest = [c for c in delta.columns if c not in counts]
        sums = self.read(now, hit).unionByName(delta).groupBy(*rest).agg(*[F.sum(c).alias(c) for c in counts])
        written = self._write(sums.filter(" or ".join(f"`{c}` <> 0" for c in counts)), now + 1)
        entries = {(b, d) for b, d in self._entries(now) if b not in hit} | {(b, now + 1) for b in written}
        return self._publish(now + 1, entries, batch)
