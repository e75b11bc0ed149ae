"""What the operators of this subpackage share: the shared folder, written tables, text batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: A key counts as heavy if it has more than one row in so many; there can be no more heavy keys than this, so that their rows can be broadcast.
HEAVY = 50_000
LEAST_HEAVY = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which every executor sees. Where it is unset, one is made for a local master; elsewhere that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="slotloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/slotloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: it cuts the lineage and outlives lost executors. ``forget`` deletes all such tables."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Deletes what this application has written to the shared folder. Results that are not yet written elsewhere become unreadable."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/slotloom/{spark.sparkContext.applicationId}")
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop_written(df: DataFrame) -> None:
    """Deletes the files of a table that ``written`` made and that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/slotloom/" in folder:
            where = spark._jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def joined(rows: DataFrame, side: DataFrame, keys: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``side``, which has one row for each key and in ``count`` how many of ``rows`` have it (dropped in the result); ``total`` is the number of ``rows``.

    Keys with more than ``max(LEAST_HEAVY, total / HEAVY)`` rows, of which there are ``HEAVY`` at most, are broadcast; the others, none of which is a
    task of its own, meet by shuffle. ``rows`` and ``side`` are read twice: give written tables.
    """
    bound = max(LEAST_HEAVY, total // HEAVY)
    heavy, light = side.where(F.col(count) > bound).drop(count), side.where(F.col(count) <= bound).drop(count)
    known = heavy.select(*keys)
    return rows.join(F.broadcast(heavy), keys).unionByName(rows.join(F.broadcast(known), keys, "left_anti").join(light, keys, how))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front while ``df`` has a column of that name (case aside)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns or "*")


def fold(n: int):
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % F.lit(n)


def slices(batch: pa.RecordBatch, text: str, rows: int = 512, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` of at most ``rows`` rows and about ``size`` bytes of ``text`` (one row may be larger), to bound a worker's memory."""
    lengths = pc.binary_length(batch[text]).fill_null(0).to_pylist()
    start = held = 0
    for i, n in enumerate(lengths):
        if i > start and (i - start >= rows or held + n > size):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield batch.slice(start)
