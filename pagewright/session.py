"""Session helpers: building a session and finding shared scratch space.

On a cluster the checkpoint / scratch location must be a shared folder named
by ``spark.checkpoint.dir``.  Only when that setting is absent and the master
is local (tests, laptops) do we create a folder of our own.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # a repeated failure adds to stored key/value data, the newest value wins
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # keyed stream state (per domain, per URL) can outgrow executor memory:
    # keep it in RocksDB, checkpointing only the changes of each micro-batch
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def build_session(master: str | None = None, app: str = "pagewright",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Reads ``spark.checkpoint.dir`` from the session.  When it is unset and the
    master is local, a folder under the system temp dir is created and stored
    back into the session (this is the test setup); on a cluster an unset
    value is an error, because executor-local folders do not survive the loss
    of an executor.
    """
    sc = spark.sparkContext
    root = sc.getCheckpointDir()
    if root:
        return root.rstrip("/")
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not _is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        root = tempfile.mkdtemp(prefix="pagewright-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    sc.setCheckpointDir(root)
    found = sc.getCheckpointDir() or root
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    root = checkpoint_root(spark)
    # the checkpoint dir gets a random sub-folder from Spark; keep ours beside it
    base = root.rsplit("/", 1)[0] if "/" in root else root
    return f"{base}/pagewright-scratch/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (never local)."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=eager)


def scale_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 256 << 20) -> dict:
    """Suggested sizes for a cluster run over ``input_bytes`` of input.

    Shuffle partitions are sized so one partition holds about
    ``target_partition_bytes`` of the largest shuffle (assumed no larger than
    the input), rounded up to a multiple of the core count; AQE then merges
    small partitions and splits skewed ones at runtime.  File splits are
    capped at 256 MB so a scan task fits comfortably in executor memory.
    """
    parts = max(total_cores, -(-input_bytes // target_partition_bytes))
    parts = -(-parts // total_cores) * total_cores
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(256 << 20),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``pagewright`` importable on the Python workers (``--py-files``).

    Operators that run Python on executors (pandas UDFs, ``mapInPandas``,
    ``applyInPandasWithState``) refer to functions of this package; the
    workers import it from a zip that Spark distributes with ``addPyFile``.
    Done once per application; a no-op when the package is shipped already.
    """
    import io
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.join("pagewright", os.path.relpath(full, pkg_dir)))
    # the zip is a driver file that Spark itself copies to every executor
    path = os.path.join(tempfile.mkdtemp(prefix="pagewright-pyfiles-"), "pagewright.zip")
    with open(path, "wb") as f:
        f.write(buf.getvalue())
    sc.addPyFile(path)
    _SHIPPED.add(key)
