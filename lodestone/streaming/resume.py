"""Incremental runs: resume, audit, and batches that can be repeated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import append_results, done_minus_failed, remaining
from ..session import cut_lineage
from ..sources.readers import optional

EMPTY_MEASURES = {"weighted_score": 0.0, "manifest_match": False, "source_match": False,
                  "total_imports": 0, "total_calls": 0}


def resume(expected: DataFrame, existing: DataFrame, work: Callable[[DataFrame], DataFrame],
           key: str = "repo", status: str = "file_count") -> DataFrame:
    """Old results without failures, plus ``work`` on the keys still to do.

    A key with any failed row is done again; its other old rows stay, as published. Write
    the result to a new path: a path being read must not be overwritten.
    """
    todo = remaining(expected.select(key).distinct(), done_minus_failed(existing, key, status), key)
    return append_results(existing.filter(F.col(status) != -1), work(todo))


def coverage_audit(expected: DataFrame, results: DataFrame, keys: list[str],
                   status: str = "file_count") -> DataFrame:
    """Every expected row; those without a result carry zero measures and status -1."""
    filled = expected.select(*keys).join(results, keys, "left")
    filled = filled.withColumn(status, F.coalesce(F.col(status), F.lit(-1)))
    return filled.fillna({k: v for k, v in EMPTY_MEASURES.items() if k in results.columns})


def run_batches(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str,
                checkpoint: str) -> int:
    """Run ``work`` on every micro-batch not processed yet and stop.

    Each batch has its own folder, which a repeated batch overwrites, so a run that was
    interrupted anywhere can be started again and ends with the same rows.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return each_batch(stream, store, checkpoint)


def upsert(rows: DataFrame, out: str, key: str, buckets: int = 64) -> None:
    """Replace in the table at ``out`` all rows of the keys that ``rows`` has, and add the others.

    The table lies in ``buckets`` folders by the key's hash, and only folders that ``rows``
    touches are read and written anew, each replaced as a whole. Doing it again with the same rows
    changes nothing, so an interrupted run is simply repeated. The number of buckets is fixed by
    the first run; null keys are a key. Columns keep their order, new ones are not added.
    """
    spark = rows.sparkSession
    fresh = cut_lineage(rows.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")))
    touched = [r[0] for r in fresh.select("_bucket").distinct().collect()]  # no more than buckets
    if not touched:
        return
    held = optional(lambda: spark.read.schema(fresh.schema).parquet(out), spark, fresh.schema)
    names = fresh.select(F.col(key).alias("_key")).distinct()
    old = held.filter(F.col("_bucket").isin(touched)).select(*fresh.columns)
    kept = old.join(names, old[key].eqNullSafe(names["_key"]), "left_anti")
    (fresh.union(kept).repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("_bucket").parquet(out))


def upsert_batches(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str,
                   key: str, buckets: int = 64) -> int:
    """Run ``work`` on every micro-batch not processed yet, upsert its rows by ``key``, and stop.
    ``out`` then has for each key the rows of the newest batch that had it, and needs no view."""
    return each_batch(stream, lambda batch, _: upsert(work(batch), out, key, buckets), checkpoint)


def each_batch(stream: DataFrame, store: Callable[[DataFrame, int], None], checkpoint: str) -> int:
    query = (stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return len(query.recentProgress)


def latest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Upsert view of the batches: per key the row of the newest batch."""
    rows = spark.read.parquet(out)
    values = [c for c in rows.columns if c not in (*keys, "batch_id")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("_row"))
    return newest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in values])


def merged(spark: SparkSession, out: str, keys: list[str], sums: list[str]) -> DataFrame:
    """Additive view of the batches: partial sums per key added up."""
    return spark.read.parquet(out).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
