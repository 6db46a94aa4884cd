"""Session helpers.

Library code never creates its own session; callers pass one in.  These
helpers build a session with the settings the operators assume (UTC, AQE with
skew-join splitting, no UI) and resolve the checkpoint folder from the session
instead of inventing a machine-local one.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def launch_conf() -> dict[str, str]:
    """Settings that the launcher has already made: a live session's or JVM's, the
    ``--conf`` arguments of spark-submit, and spark-defaults.conf."""
    import shlex

    from pyspark import SparkConf, SparkContext

    known: dict[str, str] = {}
    folder = os.environ.get("SPARK_CONF_DIR") or os.path.join(os.environ.get("SPARK_HOME", ""), "conf")
    path = os.path.join(folder, "spark-defaults.conf")
    if os.path.isfile(path):
        with open(path) as f:
            known |= dict(x.split(None, 1) for x in map(str.strip, f) if x and not x.startswith("#") and len(x.split(None, 1)) == 2)
    args = shlex.split(os.environ.get("PYSPARK_SUBMIT_ARGS", ""))
    for flag, value in zip(args, args[1:]):
        if flag == "--conf" and "=" in value:
            k, v = value.split("=", 1)
            known[k] = v
        elif flag == "--driver-memory":
            known["spark.driver.memory"] = value
    if SparkContext._gateway is not None:
        known |= dict(SparkConf().getAll())
    active = SparkSession.getActiveSession()
    if active is not None:
        known |= dict(active.sparkContext.getConf().getAll())
    return known


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app_name: str = "tidewire", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session.  Defaults, also the shuffle width, the driver's memory
    and the checkpoint folder, are set only where the launcher has set nothing; ``extra``
    is what the caller asks for and always holds."""
    known = launch_conf()
    wanted = {**DEFAULT_CONF, "spark.sql.shuffle.partitions": str(shuffle_partitions),
              "spark.driver.memory": os.environ.get("TIDEWIRE_DRIVER_MEMORY", "8g")}
    conf = {k: v for k, v in wanted.items() if k not in known} | (extra or {})
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is configured by the operator of the cluster and is
    only read here.  When it is unset (tests, a laptop) a fresh scratch folder
    is created and registered, so ``DataFrame.checkpoint()`` works everywhere.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 -- Spark Connect: only the SQL conf is visible
        d = spark.conf.get("spark.checkpoint.dir", None)
        if not d:
            raise RuntimeError("spark.checkpoint.dir is not set")
        return d
    d = sc.getCheckpointDir()
    if d:
        return d
    d = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a shared folder (HDFS/S3/...) "
                               "for lineage cuts; a machine-local folder is unsafe on a cluster")
        d = tempfile.mkdtemp(prefix="tidewire-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def written_bytes(table) -> int:
    """Bytes of the files of a table that ``materialize`` wrote."""
    spark, path = table.sparkSession, table._materialized_at
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def dematerialize(*tables) -> None:
    """Delete the folders of tables that ``materialize`` wrote and nobody reads any more."""
    for t in tables:
        spark, path = t.sparkSession, t._materialized_at
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df, name: str, *by: str):
    """Write ``df`` as Parquet under the checkpoint folder and read it back.

    Cuts the lineage at a stage boundary (an executor lost later does not
    re-run the upstream) and lets several consumers share one computation;
    unlike ``checkpoint()`` the copy is columnar, so each consumer still gets
    column pruning and filter pushdown.  ``by``: columns that get folders of their own, so that a filter
    on them reads no other rows.  The shuffle files of the write go with it, where Spark offers that:
    nothing reads them once the copy stands.
    """
    import uuid
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")
    try:
        # no marker file: for each file it makes, a driver without Hadoop's native library starts a process that shares its memory
        df.write.mode("errorifexists").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").partitionBy(*by).parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    out = spark.read.parquet(path)
    out._materialized_at = path
    return out
