"""Reading inputs, row keys and written intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id in coordinates: null sorts first.
NULL_ID = -(1 << 63)


#: Rows of an Arrow batch: with long texts the usual 10 000 take hundreds of MB in the JVM and in Python.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(name, "10000"))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor and the driver see; a local one only where the session names none (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='querytide-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: a table in the shared folder that survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def removed(df: DataFrame) -> None:
    """Deletes a table of `written` that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._written)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def keyed(df: DataFrame, *columns: str) -> tuple[DataFrame, list[str]]:
    """`df` as (_id, _tag, columns) and the columns that identify a row.

    _id is doc_id with null as NULL_ID. Where doc_ids are unique they are the key; else a hash of
    the text, _tag, tells rows that share a doc_id apart. Rows equal in doc_id and text share
    their key, and so their result."""
    small_batches(df.sparkSession)
    base = df.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_id"), *[F.col(c) for c in columns])
    shared = base.groupBy("_id").count().where("count > 1").select("_id")
    if shared.isEmpty():
        return base, ["_id"]
    return base.select("_id", F.xxhash64("text").alias("_tag"), *columns), ["_id", "_tag"]


def with_tag(df: DataFrame) -> DataFrame:
    return df if "_tag" in df.columns else df.withColumn("_tag", F.lit(0).cast("long"))


def doc_id() -> F.Column:
    return F.when(F.col("_id") != NULL_ID, F.col("_id")).alias("doc_id")


def whole(df: DataFrame) -> DataFrame:
    """`df` as (_row, doc_id, text): the row as one struct beside the columns that operators read, so no name can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), "doc_id", "text")


def unpacked(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[F.col("_row").getField(c).alias(c) for c in names])
