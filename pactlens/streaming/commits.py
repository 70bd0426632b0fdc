"""A store of committed micro-batches in hash buckets of a key, with a small manifest.

Rows lie in ``data``, in a folder for every commit and bucket. A commit is one
row in ``manifest``, written after its rows: what has no such row isn't seen
by any reader, and a batch that has one is done, so a lost executor or a
restart writes nothing twice. Versions are counted in the manifest, never in
the data; a reader that knows its keys lists and reads their buckets only.
Several streams may write to one store.

Compaction rewrites all rows as the single commit of a new generation, so
the manifest and the number of files stay small however long a stream runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

BUCKETS = 32
MANIFEST = "version long, n_rows long, buckets array<int>, done map<string,long>, generation int, run string, batch long"


def run_name(checkpoint: str) -> str:
    """Name of the stream that keeps its progress in this checkpoint, also after a restart."""
    return hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Store:
    """Rows of ``schema`` in ``folder``, in buckets of ``key``; every row read has its ``version`` as well."""

    spark: SparkSession
    folder: str
    schema: str
    key: str
    buckets: int = BUCKETS

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def create(self) -> Store:
        """Make an empty store, unless there is one."""
        empty = self.spark.createDataFrame([], "version long, n_rows long, buckets array<int>, done map<string,long>")
        empty.write.mode("ignore").json(f"{self.folder}/manifest")
        return self

    def _manifest(self) -> list[Row]:
        """Commits of the newest generation, one row each."""
        rows = self.spark.read.schema(MANIFEST).json(f"{self.folder}/manifest").filter("version IS NOT NULL").collect()
        newest = max((r["generation"] for r in rows), default=0)
        return [r for r in rows if r["generation"] == newest]

    def has(self, run: str, batch: int) -> bool:
        """Whether this batch is committed already."""
        return any((r["run"], r["batch"]) == (run, batch) or batch <= (r["done"] or {}).get(run, -1) for r in self._manifest())

    def asked(self, rows: DataFrame) -> list[int]:
        """The buckets in which the keys of ``rows`` lie, at most ``buckets`` numbers."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def read(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """All committed rows, or those of some buckets."""
        wanted = None if buckets is None else set(buckets)
        paths = []
        for r in self._manifest():
            held = r["buckets"] or []
            asked = held if wanted is None else [b for b in held if b in wanted]
            # a commit of which all buckets are asked is listed by its own folder
            paths += [self._path("data", r)] if held and len(asked) == len(held) else [f"{self._path('data', r)}/bucket={b}" for b in asked]
        columns = f"{self.schema}, version long"
        if not paths:
            return self.spark.createDataFrame([], columns)
        rows = self.spark.read.schema(f"{columns}, generation int, run string, batch long, bucket int").option(
            "basePath", f"{self.folder}/data").parquet(*paths)
        if wanted is not None:
            rows = rows.filter(F.col("bucket").isin(sorted(wanted)))
        return rows.drop("generation", "run", "batch", "bucket")

    def commit(self, rows: DataFrame, run: str, batch: int) -> None:
        """Write one micro-batch with a version above all others; a batch that is committed is left alone."""
        entries = self._manifest()
        generation = max((r["generation"] for r in entries), default=0)
        version = max((r["version"] for r in entries), default=0) + 1
        self._write(rows.withColumn("version", F.lit(version).cast("long")), version, generation, run, batch, None)

    def compact(self, reduce: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
        """Rewrite all rows, thinned out by ``reduce``, as one commit of a new generation; no stream may write meanwhile."""
        entries = self._manifest()
        if not entries:
            return
        done: dict[str, int] = {}
        for r in entries:
            done |= {k: max(v, done.get(k, -1)) for k, v in [*(r["done"] or {}).items(), (r["run"], r["batch"])]}
        self._write(reduce(self.read()), max(r["version"] for r in entries), entries[0]["generation"] + 1, "compacted", 0, done)

    def drop_old_generations(self) -> None:
        """Delete what compaction has replaced."""
        newest = self._manifest()[0]["generation"]
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for kind in ("manifest", "data"):
            for generation in range(newest):
                path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}/generation={generation}")
                path.getFileSystem(conf).delete(path, True)

    def _path(self, kind: str, r) -> str:
        return f"{self.folder}/{kind}/generation={r['generation']}/run={r['run']}/batch={r['batch']}"

    def _write(self, rows: DataFrame, version: int, generation: int, run: str, batch: int, done: dict | None) -> None:
        at = {"generation": generation, "run": run, "batch": batch}
        seen = Observation()
        # a bucket is one file of the commit
        dealt = rows.withColumn("bucket", self.bucket()).repartition("bucket").observe(
            seen, F.count("*").alias("n"), F.collect_set("bucket").alias("buckets"))
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(self._path("data", at))
        facts = seen.get
        entry = self.spark.createDataFrame([(version, facts["n"], sorted(facts["buckets"] or []), done)],
                                           "version long, n_rows long, buckets array<int>, done map<string,long>")
        entry.coalesce(1).write.mode("overwrite").json(self._path("manifest", at))
