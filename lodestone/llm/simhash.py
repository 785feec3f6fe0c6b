"""Near-duplicates by SimHash, compared at the anchors of a covering code.

The first 64 bits of a fingerprint are cut in parts. Each part has its own anchors: words whose
first 15 bits form the perfect Hamming code, the others free. That code covers every word
within radius 1, so a fingerprint has a home anchor in each part, and two words at most t apart
are both within 1 + t of the home of either. A fingerprint is therefore sent to its home and to
every anchor within 1 + t, and compared with the residents there. With n parts, fingerprints at
most n (t + 1) - 1 bits apart are at most t apart in some part: no such link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import skewed_join
from ..session import cut_lineage
from .common import components, small_batches, unite

SEED = 42
CODE = 15
PAIRS = 1 << 22
ANCHOR_ROWS = 1 << 14


@dataclass(frozen=True)
class Cover:
    """Parts of the first 64 bits (first bit, width), and how far apart in one part links are."""

    parts: tuple[tuple[int, int], ...]
    apart: int

    @property
    def most(self) -> int:
        return len(self.parts) * (self.apart + 1) - 1


#: Up to 5 bits, about 46 rows a fingerprint.
NARROW = Cover(((0, 21), (21, 21), (42, 22)), 1)


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words, repeats included; fewer words make one run."""
    import xxhash

    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space parts
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(words) - width + 1)
    spans = zip(starts[:n].tolist(), ends[-n:].tolist())
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes, as a signed 64-bit number; none: 0."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """``key, fp``. Null text counts as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(shingle_hashes(value.as_py() or "", width)) for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64())], names=["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return small_batches(docs).select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, fp long")


def steps_to_anchors(width: int, radius: int) -> list[np.ndarray]:
    """Per syndrome of a word: the differences of at most ``radius`` bits that lead to an
    anchor, the home first."""
    found: list[list[int]] = [[] for _ in range(CODE + 1)]
    for size in range(radius + 1):
        for bits in combinations(range(width), size):
            syndrome = 0
            for i in bits:
                syndrome ^= i + 1 if i < CODE else 0
            found[syndrome].append(sum(1 << i for i in bits))
    return [np.array(x, np.int64) for x in found]


def at_anchors(fps: np.ndarray, cover: Cover) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the fingerprint, anchor, is it home there) for all anchors of all parts."""
    index, anchor, home = [], [], []
    for part, (low, width) in enumerate(cover.parts):
        word = ((fps.view(np.uint64) >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)
        syndrome = np.zeros(len(word), np.int64)
        for i in range(CODE):
            syndrome ^= np.where(word >> i & 1, i + 1, 0)
        for s, steps in enumerate(steps_to_anchors(width, 1 + cover.apart)):
            own = np.flatnonzero(syndrome == s)
            index.append(np.repeat(own, len(steps)))
            anchor.append((word[own][:, None] ^ steps | part << 24).ravel())
            home.append(np.tile(np.arange(len(steps)) == 0, len(own)))
    return np.concatenate(index), np.concatenate(anchor), np.concatenate(home)


def links_at_anchors(anchor: np.ndarray, home: np.ndarray, fps: np.ndarray,
                     bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as two arrays of fingerprints, of the links found in rows sorted by
    anchor. Pairs are formed a bounded number at a time and united at once, never kept."""
    first = np.flatnonzero(np.r_[True, np.diff(anchor) != 0]) if len(anchor) else np.zeros(0, int)
    size = np.diff(np.r_[first, len(anchor)])
    run = np.repeat(np.arange(len(first)), size)
    parent = np.arange(len(fps))
    residents = np.flatnonzero(home)
    residents = residents[size[run[residents]] > 1]
    count, at = size[run[residents]], 0
    ends = np.cumsum(count)
    while at < len(residents):
        done = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
        some, each = residents[at:upto], count[at:upto]
        a = np.repeat(some, each)
        within = np.arange(len(a)) - np.repeat(np.cumsum(each) - each, each)
        b = np.repeat(first[run[some]], each) + within
        close = (np.bitwise_count((fps[a] ^ fps[b]).view(np.uint64)) <= bits) & (fps[a] != fps[b])
        parent = unite(parent, a[close], b[close])
        at = upto
    child = np.flatnonzero(parent != np.arange(len(fps)))
    return fps[child], fps[parent[child]]


def fingerprint_links(nodes: DataFrame, bits: int, cover: Cover = NARROW, limit: int = ANCHOR_ROWS) -> DataFrame:
    """Links ``u, v`` that connect all fingerprints at most ``bits`` apart.

    ``nodes`` has distinct fingerprints ``fp``. Copies cost nothing here. Rows are counted by
    anchor; an anchor with more than ``limit`` is cut, its residents and its visitors each in
    blocks by hash, and every block of residents meets every block of visitors in a group of its
    own. So no group holds more than about twice the limit, whatever the corpus holds, and a task
    works through its groups in order with one of them in memory.
    """
    if bits > cover.most:
        raise ValueError(f"these anchors find links of at most {cover.most} bits")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 13):
                fps = batch.column(0).slice(at, 1 << 13).to_numpy(zero_copy_only=False)
                index, anchor, home = at_anchors(fps, cover)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.astype(np.int32)), pa.array(home), pa.array(fps[index])], names=["anchor", "home", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def found(rows):
            u, v = links_at_anchors(rows[0], rows[1], rows[2], bits)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
            if not len(rows[0]):
                continue
            cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last anchor may go on
            if cut:
                yield found([x[:cut] for x in rows])
            held = [x[cut:] for x in rows]
        if held is not None:
            yield found(held)

    dealt = nodes.select("fp").mapInArrow(deal, "anchor int, home boolean, fp long")
    blocks = [F.ceil(F.sum((F.col("home") == h).cast("int")) / limit).alias(n) for h, n in ((True, "_r"), (False, "_v"))]
    # fewer anchors than rows / limit can be above it, each with limit rows at least
    large = dealt.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n"), *blocks).filter(F.col("_n") > limit)
    large = cut_lineage(large.select("anchor", F.greatest("_r", F.lit(1)).alias("_r"), F.greatest("_v", F.lit(1)).alias("_v")))
    if large.isEmpty():
        met = dealt.withColumn("block", F.lit(0).cast("long"))
    else:
        wide = dealt.join(large, "anchor", "left")
        some = F.pmod(F.xxhash64("fp"), F.coalesce(F.when(F.col("home"), F.col("_r")).otherwise(F.col("_v")), F.lit(1)))
        other = F.coalesce(F.when(F.col("home"), F.col("_v")).otherwise(F.col("_r")), F.lit(1))
        # residents also visit each other: they go to the blocks of visitors and of residents
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_other") - 1))
        met = wide.select("anchor", "home", "fp", some.alias("_some"), other.cast("long").alias("_other"),
                          F.coalesce("_v", F.lit(1)).cast("long").alias("_width"), F.coalesce("_r", F.lit(1)).cast("long").alias("_high"))
        guests = met.select("anchor", "home", "fp", "_some", "_width", every.alias("_at")).select(
            "anchor", "home", "fp", F.when(F.col("home"), F.col("_some") * F.col("_width") + F.col("_at"))
            .otherwise(F.col("_at") * F.col("_width") + F.col("_some")).alias("block"))
        again = met.filter("home and _high > 1").select(
            "anchor", F.explode(F.array(F.lit(True), F.lit(False))).alias("home"), "fp", "_some", "_high").select(
            "anchor", "home", "fp", "_some", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_high") - 1)).alias("_at"), "_high").select(
            "anchor", "home", "fp", (-1 - F.when(F.col("home"), F.col("_some") * F.col("_high") + F.col("_at"))
                                     .otherwise(F.col("_at") * F.col("_high") + F.col("_some"))).alias("block"))
        met = guests.union(again)
    group = F.when(F.col("block") == 0, F.col("anchor").cast("long")).otherwise(F.xxhash64("anchor", "block"))
    return (met.select(group.alias("group"), "home", "fp").repartition("group").sortWithinPartitions("group")
            .mapInArrow(compare, "u long, v long").distinct())


def near_duplicates(docs: DataFrame, key: str, text: str, width: int, bits: int) -> DataFrame:
    """``key, fp, component``: documents whose fingerprints are linked, directly or through
    others, share the smallest key reachable. Links: at most ``bits`` of 64 differ, at most 5;
    none is lost.

    Null and empty texts have fingerprint 0 and link like any other. Repeated rows and equal
    fingerprints are one node. Null keys are never a component's name unless all are null.
    Rows of a large component, and those of a fingerprint with many copies, are spread in the
    joins that name them.
    """
    prints = cut_lineage(fingerprints(docs, key, text, width))
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min("key").alias("least")))
    roots = components(fingerprint_links(nodes, bits)).withColumnRenamed("node", "fp")
    rooted = cut_lineage(nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    names = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = skewed_join(rooted, names, "root", F.col("fp")).select("fp", "component")
    return skewed_join(prints, named, "fp", F.col("key")).select("key", "fp", "component")


def one_of_each(docs: DataFrame, key: str, text: str, width: int, bits: int) -> DataFrame:
    """``docs`` without near-duplicates: of each group of ``near_duplicates`` the document with the
    smallest key stays, one row of it.

    A repeated key stays if any of its rows gives its group the name. Rows without a key cannot be
    told apart and stay. Only keys are looked up; what is dropped is the smaller side.
    """
    own = F.coalesce(F.col("key") == F.col("component"), F.lit(False))
    found = near_duplicates(docs, key, text, width, bits).filter("key is not null")
    marks = cut_lineage(found.groupBy(F.col("key").alias("_simhash_key")).agg(
        F.bool_or(own).alias("_stays"), F.count(F.lit(1)).alias("_times")).filter("not _stays or _times > 1"))
    settled = docs.join(marks, docs[key] == marks["_simhash_key"], "left_anti")
    again = docs.join(marks.filter("_stays"), docs[key] == marks["_simhash_key"], "left_semi")
    turn = Window.partitionBy(key).orderBy(F.xxhash64(text))
    first = again.withColumn("_simhash_turn", F.row_number().over(turn)).filter("_simhash_turn = 1")
    return settled.union(first.select(*docs.columns))
