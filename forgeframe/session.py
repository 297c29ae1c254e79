"""Local session used by tests, the benchmark and small tools; a cluster brings its own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: int = 8, partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A ``local[cpus]`` session with UTC time, AQE and as many shuffle partitions as cores."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("forgeframe")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def load(spark: SparkSession, sf_dir: str, name: str):
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the session's checkpoint folder.

    Where neither is set, a folder of this machine is set for the session, if that is all its cluster.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="forgeframe-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")
