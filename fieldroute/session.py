"""Session helpers shared by every operator: code shipping, shared folders, table reads."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_ROWS: dict[tuple[str, str, str], int] = {}
#: Rows that a task of a wide join or grouping is to hold at most.
TASK_ROWS = 500_000


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, as ``addPyFile`` does for any job."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    path = Path(tempfile.mkdtemp()) / f"{root.name}.zip"  # read by the driver's own file server only
    path.write_bytes(packed.getvalue())
    sc.addPyFile(str(path))
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only where none is configured and all runs on this machine (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="fieldroute-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there.

    The written table survives the loss of any executor and fixes whatever was
    sampled or numbered upstream, so later passes all see the same rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fieldroute/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def wide_tasks(spark: SparkSession, sf_dir: str, name: str = "lineitem") -> int:
    """Tasks for the rows of a table: the session's width, or more where ``TASK_ROWS`` rows a task need more.

    Rows are counted (from footers) once an application; an old count only changes how rows are dealt.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _ROWS:
        _ROWS[key] = table(spark, sf_dir, name).count()
    return max(shuffle_width(spark), -(-_ROWS[key] // TASK_ROWS))


def spread(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """``df`` dealt by its keys over ``tasks`` where these are more than the session's width, else as it is.

    On the smaller side of a join this sets the width of both: the other side follows, unless Spark broadcasts this one.
    """
    return df.repartition(tasks, *keys) if tasks > shuffle_width(df.sparkSession) else df
