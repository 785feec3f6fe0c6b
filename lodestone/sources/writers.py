"""Writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators.scoring import score_report, submission
from ..session import cut_lineage


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_scores(scored: DataFrame, report_path: str, submission_path: str) -> None:
    """Both result tables of one scoring run. The report is computed once and kept in the
    shared folder; the two CSVs are cut from it."""
    report = cut_lineage(score_report(scored))
    write_csv(report, report_path)
    write_csv(submission(report), submission_path)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int = 64, path: str | None = None) -> DataFrame:
    """Write ``df`` as a table of ``buckets`` files by the key's hash, each in order of the key,
    and read it again. Tables of one number of buckets join and group by the key without an
    exchange. ``path``: where the files go, else to the warehouse."""
    out = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    (out.option("path", path) if path else out).saveAsTable(table)
    return df.sparkSession.table(table)


def write_json(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """One JSON object per row."""
    df.write.mode("overwrite").partitionBy(*partition_by).json(path)
