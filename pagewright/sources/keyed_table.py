"""A table with one row for each key, changed by micro-batches.

Rows live in buckets by a hash of the key.  A commit writes the changed rows of
the buckets that it touches into a folder of its own and then a manifest, one
small file, that lists for every bucket the folders that make it up: a base and
the changes since.  Readers take the newest manifest and, of each key, the row
of the newest folder; so a commit shows as a whole or not at all, and what a
failed one has written is overwritten by the next.  A bucket with
``compact_every`` folders is written anew as a base.  Buckets that a commit
doesn't touch are neither read nor written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import folders

_MANIFEST = "bucket int, folder int, base boolean, batch bigint"


class KeyedTable:
    """Rows of ``schema``, one for each value of ``key``."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: T.StructType | str,
                 n_buckets: int = 16, compact_every: int = 8):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.n_buckets, self.compact_every = n_buckets, compact_every

    # -- manifests: at most n_buckets * compact_every rows

    def _manifest(self) -> tuple[int, list]:
        versions = [int(p.rsplit("=", 1)[1]) for p in folders.matching(self.spark, f"{self.path}/manifest/version=*")
                    if folders.matching(self.spark, f"{p}/*.parquet")]
        if not versions:
            return 0, []
        newest = max(versions)
        return newest, self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/version={newest}").collect()

    def committed(self, batch: int) -> bool:
        """Whether a micro-batch is in the table already (a replay may skip it)."""
        return any(r["batch"] >= batch for r in self._manifest()[1])

    def bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.n_buckets)).cast("int")

    def _rows(self, live: list) -> DataFrame:
        """The current rows of the buckets that the manifest rows name."""
        stored = T.StructType([*self.schema.fields, T.StructField("_gone", T.BooleanType()),
                               T.StructField("folder", T.IntegerType()), T.StructField("bucket", T.IntegerType())])
        paths = sorted({f"{self.path}/data/folder={r['folder']}/bucket={r['bucket']}" for r in live
                        if r["folder"] is not None})
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        t = self.spark.read.schema(stored).option("basePath", f"{self.path}/data").parquet(*paths)
        rest = [f.name for f in self.schema.fields if f.name != self.key]
        newest = t.groupBy(self.key).agg(F.max_by(F.struct("_gone", *rest), "folder").alias("_r"))
        return newest.filter(~F.col("_r._gone")).select(*[F.col(c) if c == self.key else F.col(f"_r.{c}").alias(c)
                                                         for c in self.schema.names])

    def read(self) -> DataFrame:
        return self._rows(self._manifest()[1])

    def read_for(self, keys: DataFrame) -> DataFrame:
        """The rows of the keys in ``keys``; only their buckets are read."""
        wanted = keys.select(self.key).distinct()
        touched = {r[0] for r in wanted.select(self.bucket()).distinct().collect()}
        rows = self._rows([r for r in self._manifest()[1] if r["bucket"] in touched])
        return rows.join(wanted, self.key, "left_semi")

    # -- commits

    def commit(self, changes: DataFrame, batch: int | None = None) -> None:
        """Insert or replace rows by key; rows with a true ``_gone`` are deleted.

        ``changes`` has one row for each key.  ``batch`` is the micro-batch that
        they come from; a batch that is in the table already changes nothing.
        """
        version, live = self._manifest()
        if batch is not None and any(r["batch"] >= batch for r in live):
            return
        version += 1
        if "_gone" not in changes.columns:
            changes = changes.withColumn("_gone", F.lit(False))
        names = [*self.schema.names, "_gone"]
        # written first, so that what is compacted below reads them from there
        staged = f"{self.path}/staged"
        changes.select(*names, self.bucket().alias("bucket")).write.mode("overwrite").parquet(staged)
        staged_schema = T.StructType([*self.schema.fields, T.StructField("_gone", T.BooleanType()),
                                      T.StructField("bucket", T.IntegerType())])
        new = self.spark.read.schema(staged_schema).parquet(staged)
        touched = {r[0] for r in new.select("bucket").distinct().collect()}
        count = {b: sum(r["bucket"] == b for r in live) for b in touched}
        full = {b for b in touched if count[b] + 1 >= self.compact_every or not count[b]}
        kept = [r for r in live if r["bucket"] in full]
        out = new.filter(~F.col("bucket").isin(*full) | ~F.col("_gone")) if full else new
        if kept:
            old = self._rows(kept).join(new.select(self.key), self.key, "left_anti")
            out = out.unionByName(old.select(*self.schema.names, F.lit(False).alias("_gone"),
                                             self.bucket().alias("bucket")))
        (out.hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket")
         .parquet(f"{self.path}/data/folder={version}"))
        written = {int(p.rsplit("=", 1)[1]) for p in
                   folders.matching(self.spark, f"{self.path}/data/folder={version}/bucket=*")}
        rows = [(r["bucket"], r["folder"], r["base"]) for r in live if r["bucket"] not in full and r["folder"] is not None]
        rows += [(b, version, b in full) for b in sorted(written)]
        done = max([-1 if batch is None else batch, *[r["batch"] for r in live]])
        # an empty table is a manifest that names no folder
        manifest = self.spark.createDataFrame([(*r, done) for r in rows or [(None, None, None)]], _MANIFEST)
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")
        self._forget(version)

    def _forget(self, version: int) -> None:
        """Delete what neither the newest manifest nor the one before names."""
        for p in folders.matching(self.spark, f"{self.path}/manifest/version=*"):
            if int(p.rsplit("=", 1)[1]) < version - 1:
                folders.delete(self.spark, p)
        named = set()
        for p in folders.matching(self.spark, f"{self.path}/manifest/version=*"):
            named |= {(r["folder"], r["bucket"]) for r in self.spark.read.schema(_MANIFEST).parquet(p).collect()}
        for p in folders.matching(self.spark, f"{self.path}/data/folder=*/bucket=*"):
            folder, bucket = (int(x.rsplit("=", 1)[1]) for x in p.split("/")[-2:])
            if (folder, bucket) not in named:
                folders.delete(self.spark, p)
