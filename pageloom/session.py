"""Session settings, the shared folder, and reliable checkpoints."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings that fit any size; partition counts are left to AQE.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int = 8, partitions: int = 8, app: str = "pageloom", **conf: str) -> SparkSession:
    """A session on this machine, for tests and the bench. On a cluster, pass your own session instead."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in (DEFAULTS | {"spark.sql.shuffle.partitions": str(partitions), "spark.ui.enabled": "false"} | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Where it is unset (tests on one
    machine), a folder of this process is set and used; on a cluster it has to be set."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    have = spark.sparkContext._jsc.sc().getCheckpointDir()
    if got:
        if not have.isDefined():
            spark.sparkContext.setCheckpointDir(got)
        return got.rstrip("/")
    if have.isDefined():
        return have.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = os.path.join(tempfile.gettempdir(), f"pageloom-{os.getpid()}")
    own = f"file://{folder}"
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return own


def materialised(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder; it survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_written: dict[str, list[str]] = {}


def shared_path(spark: SparkSession, kind: str) -> str:
    """A fresh path below the shared folder; ``clean_shared`` removes what was written there."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clean_shared(spark: SparkSession) -> int:
    """Removes what this application wrote below the shared folder: call it when its results are saved.
    Checkpoints go with spark.cleaner.referenceTracking.cleanCheckpoints, or with the folder."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    return len(paths)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once for each application; Spark serves the archive itself."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.gettempdir(), f"pageloom-{app}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    atexit.register(archive.unlink, missing_ok=True)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
