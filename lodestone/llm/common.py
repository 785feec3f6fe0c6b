"""Helpers that several operators of this folder share."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import skewed_join
from ..session import cut_lineage

#: Bounds of what models are fitted on, besides the number of rows a label.
MOST_LABELS = 64
MOST_BYTES = 1 << 20
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of texts that a Python worker is sent at once, and the setting that says so.
BATCH_BYTES = 1 << 21
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def md5_bits(value: Column) -> Column:
    """The first 60 bits of a string's MD5 as a long: a hash that SQL engines share."""
    return F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("long")


def small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, whose session from now on sends rows to Python in batches that end at ``BATCH_BYTES``
    (the row that reaches it is the last), unless it has a size of its own set.

    Spark's own limits, 64 MiB and 10,000 rows, put a whole scan task's texts in one batch: in the
    executor's buffers, which it keeps, in the worker, and again on the way back. How rows are cut
    in batches changes no result.
    """
    conf = docs.sparkSession.conf
    if BATCH_SETTING not in conf.getAll:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return docs


def chunks_of(texts: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, list[str]]]:
    """(position of the first, texts) in pieces of about ``limit`` characters; null is ''.

    A longer text comes alone and whole, so memory follows the longest text at most.
    """
    first, held, size = 0, [], 0
    for i, value in enumerate(texts):
        text = value.as_py() or ""
        if held and size + len(text) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield first, held


def remainder(key: Column, n: int) -> Column:
    """CRC-32 of a key as text, modulo n."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(n))


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str,
                    per_label: int) -> DataFrame:
    """``key, label, text``: about ``per_label`` documents of each of the ``MOST_LABELS`` most
    frequent labels, all if there are fewer: those whose key's hash falls below the share wanted.
    One row of a repeated key.

    For fitting, so bounded: texts of more than ``MOST_BYTES`` are not learned from, and texts are
    read for the chosen keys only. Null keys, labels and texts are left out.
    """
    marks = labels.select(F.col(key).alias("key"), F.col(label).alias("label")).filter(
        "key is not null and label is not null")
    sizes = marks.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(MOST_LABELS)
    share = F.pmod(F.xxhash64("key", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    chosen = marks.join(F.broadcast(sizes), "label").filter(share < per_label / F.col("n")).select(
        "key", "label").distinct()
    read = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(
        (F.octet_length("text") <= MOST_BYTES))
    return read.join(F.broadcast(chosen), "key").groupBy("key", "label").agg(F.min("text").alias("text"))


def fitted(sample: DataFrame, train: Callable[[list[tuple]], object]) -> object:
    """The model that ``train`` makes of the (label, text) of a bounded ``sample``, in order of
    key. It is fitted in one task of an executor; only the model comes to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        model = pickle.dumps(train([(label, text) for _, label, text in rows]))
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    made = sample.select("key", "label", "text").repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(made[0].model) if made else train([])


def text_beside(docs: DataFrame, text: str, keep: Sequence[str]) -> tuple[DataFrame, int]:
    """(the kept columns and the text, the text's place); a kept text is not sent twice, and rows
    come in ``small_batches``."""
    docs = small_batches(docs)
    if text in keep:
        return docs.select(*keep), list(keep).index(text)
    return docs.select(*keep, F.col(text).alias("_text")), len(keep)


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the trees of ``a[i]`` and ``b[i]``; every node then points at its smallest."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return parent
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            jumped = parent[parent]
            if np.array_equal(jumped, parent):
                break
            parent = jumped


def _minima(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node move to the smallest node around it."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _minima(both).select("u", F.least("u", "m").alias("m"))
    return (skewed_join(both, least, "u", F.col("v")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of a node, and the node itself, move to the smallest of them."""
    least = _minima(edges)
    moved = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``u, v`` links: ``node, root``, the root being the smallest
    node reachable. Roots and nodes without links have no row.

    Stars are contracted in rounds until nothing moves, so rounds grow with the logarithm of
    a path's length. Minima are combined before each shuffle, and the links of a hub are
    spread by their other end. Each round is written to the
    shared folder. Links stay in tables; the driver sees one checksum a round.
    """
    oriented = edges.filter("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    state, seen = cut_lineage(oriented), None
    while True:
        mark = state.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if mark == seen or mark[0] == 0:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
        state = cut_lineage(_small_star(_large_star(state)))
