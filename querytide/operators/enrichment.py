"""Statement features in batches that survive an interruption."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import Store
from .grouping import features

#: Distinct statements of a batch.
BATCH_ROWS = 1_000_000
#: Commits of a run at most; beyond so many batches a commit takes several, as each has its own jobs and its own version.
MOST_COMMITS = 64
#: Parts that the statements of a commit are dealt to, so that several tasks analyse them: one file is one task's work.
PARTS = 16
CACHE, PENDING = "statement_features", "_pending"


def keyed(queries: DataFrame) -> DataFrame:
    return queries.where(F.col("sql_text").isNotNull()).withColumn("sql_hash", F.sha2("sql_text", 256))


def enriched(queries: DataFrame, store: Store, batch_rows: int = BATCH_ROWS, analyse: Callable[[DataFrame], DataFrame] = features, after: Callable[[int, int], None] | None = None) -> tuple[DataFrame, dict[str, int]]:
    """Queries with the features of their statements, and how many distinct statements were known and new.

    What the cache lacks is gathered once and dealt into batches by hash; each batch is analysed and committed to the
    store on its own, so a run that is killed loses the batch it was in (of more than MOST_COMMITS batches its share of the run) and no more, and
    the next run analyses only what no committed batch holds. Statements are known by the SHA-256 of their text. after: called with (batch, batches) after each commit."""
    own = keyed(queries)
    distinct = own.groupBy("sql_hash").agg(F.min("sql_text").alias("sql_text"))
    known = store.read(CACHE).select("sql_hash") if store.exists(CACHE) else None
    unseen = distinct if known is None else distinct.join(known, "sql_hash", "left_anti")
    pending = f"{store.root}/_staging/{PENDING}"
    unseen.write.mode("overwrite").parquet(pending)
    waiting = store.spark.read.schema(unseen.schema).parquet(pending)
    total = waiting.count()
    batches = -(-total // batch_rows)
    run = store.manifest()["number"]
    step = max(1, -(-batches // MOST_COMMITS))
    batch = F.pmod(F.xxhash64("sql_hash"), F.lit(max(batches, 1))).cast("int")
    dealt = waiting.withColumn("_batch", batch).withColumn("_commit", F.floor(F.col("_batch") / step).cast("int"))
    if batches > 1:  # each commit reads its own folder, not all that waits
        dealt.repartition("_commit", F.pmod(F.xxhash64("sql_hash", F.lit(1)), F.lit(PARTS))).write.mode("overwrite").partitionBy("_commit").parquet(f"{pending}_dealt")
    for c in range(-(-batches // step)):
        part = store.spark.read.schema(dealt.drop("_commit").schema).parquet(f"{pending}_dealt/_commit={c}") if batches > 1 and store.files.exists(f"{pending}_dealt/_commit={c}") else dealt.where(F.col("_commit") == c)
        made = analyse(part).drop("sql_text", "_commit").withColumns({"snapshot_id": F.lit("features"), "namespace_id": F.concat(F.lit(f"{run}-"), F.col("_batch").cast("string"))}).drop("_batch")
        store.replace(CACHE, made)
        if after:
            after(min((c + 1) * step, batches), batches)
    counts = {"new": total, "known": own.select("sql_hash").distinct().count() - total}
    if not store.exists(CACHE):
        return own, counts
    return own.join(store.read(CACHE).drop("snapshot_id", "namespace_id"), "sql_hash", "left"), counts
