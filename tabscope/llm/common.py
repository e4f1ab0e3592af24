"""What the operators share: reading tables, staging between jobs, Python over batches."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a session, so that it need not be
    installed on the executors."""
    context = spark.sparkContext
    if getattr(context, "_tabscope_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="tabscope-code-")) / "tabscope.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._tabscope_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, the folder that driver and executors share.

    Only a local session, where one machine does everything, may be without it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tabscope-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes a table to the shared folder and reads it: later jobs neither repeat
    the work nor depend on the executors that did it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_batches(frames: Iterator[pd.DataFrame], weigh: str, most: int) -> Iterator[pd.DataFrame]:
    """Cuts frames so that the texts of a piece hold about ``most`` characters."""
    for frame in frames:
        if not len(frame):
            continue
        sizes = frame[weigh].str.len().fillna(0).to_numpy(dtype="int64").cumsum()
        pieces = sizes // max(most, 1)
        start = 0
        for stop in [*((pieces[1:] != pieces[:-1]).nonzero()[0] + 1).tolist(), len(frame)]:
            yield frame.iloc[start:stop]
            start = stop


def held_out(doc_id: Column) -> Column:
    """The fold whose labels no model may learn from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def training_labels(labels: DataFrame, name: str, per_class: int | None) -> DataFrame:
    """At most ``per_class`` (None: all) labelled documents of either class, outside the held-out fold.

    Rows without id or label do not count, nor do documents with contradicting labels.
    The rows kept are the first in hash order, so the choice does not depend on files.
    """
    usable = (
        labels.where(F.col(name).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min(name).alias("label"), F.max(name).alias("_most"))
        .where("label = _most").select("doc_id", F.col("label").cast("int").alias("label"))
    )
    if per_class is None:
        return usable
    first = [usable.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    return first[0].unionByName(first[1])


def schema_of(df: DataFrame, **more: str) -> T.StructType:
    """The table's schema with further columns (Spark type names)."""
    kept = [f for f in df.schema.fields if f.name not in more]
    return T.StructType(kept + [T.StructType.fromDDL(f"{n} {t}").fields[0] for n, t in more.items()])
