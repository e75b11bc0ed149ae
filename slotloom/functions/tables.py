"""Tables written in the middle of a job, to cut its lineage, and joins with sides of a checked size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast up to so many narrow rows (about 10 MB), which are counted before.
SMALL = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which every executor sees. Where it is unset, one is made for a local master; elsewhere that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="slotloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path.rstrip('/')}/slotloom/{spark.sparkContext.applicationId}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again; ``forget`` deletes all such tables."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables that are derived once in an application, by the application and what they are derived from.
REMEMBERED: dict[tuple, object] = {}


def forget(spark: SparkSession) -> None:
    """Deletes the tables that this application has written to the shared folder. Results that are not yet written elsewhere become unreadable."""
    for key in [k for k in REMEMBERED if k[0] == spark.sparkContext.applicationId]:
        del REMEMBERED[key]
    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """``df``, to be broadcast if it is counted to have at most ``rows`` rows. Give a written or otherwise cheap table."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
