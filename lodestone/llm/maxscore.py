"""Exact top-k by inner product with MaxScore, over vectors of whole numbers.

Every component is a term. Within a block of neighbouring records a term's list has a largest and
a smallest entry, so a query's weight gives the most that the term can add there. Terms are put in
order of that bound; those with the smallest bounds whose sum stays below the k-th best score are
non-essential: a record needs something from the others to enter. Essential lists are traversed
for all queries of a block at once, and the non-essential terms are probed, some at a time, for
the records that are still competitive.

Records are dealt to shards by cluster. One bar for each query comes from a bounded sample, before
anything is compared: a query goes only to shards with a cluster whose bounds reach its bar, and
there only to blocks whose bounds do. Shards return k records a query, which are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .multi_index import NONE, deal, fit_codes, placed, products
from .rotation_codes import matrix

SHARD_ROWS = 4096
BLOCK_ROWS = 512
SLACK = 1e-9
BLOCK_QUERIES = 1024
SAMPLE = 8192
CLUSTERS = 512
PROBE = 8


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best different ids: of a repeated id the best score counts, and it counts once."""
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    once = np.sort(np.unique(ids, return_index=True)[1])[:k]
    return ids[once], scores[once]


def most(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """(places x queries) most that a record can score whose entries lie from ``low`` to ``high``
    (places x terms), and as much more as rounding could hide."""
    return high @ np.maximum(queries, 0).T + low @ np.minimum(queries, 0).T + SLACK * (
        np.maximum(np.abs(high), np.abs(low)) @ np.abs(queries).T)


def cuts(cluster: np.ndarray, block_rows: int) -> np.ndarray:
    """Where blocks begin in records ordered by cluster: at a new cluster once a block has a
    quarter of its rows, and when it is full."""
    starts, at = [], 0
    changes = np.flatnonzero(np.diff(cluster)) + 1
    while at < len(cluster):
        starts.append(at)
        next_ = np.searchsorted(changes, at + max(1, block_rows // 4))
        at = min(at + block_rows, int(changes[next_]) if next_ < len(changes) else len(cluster))
    return np.array(starts, np.int64)


class Shard:
    """Records of one shard (rows of whole numbers) in blocks of neighbours."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, cluster: np.ndarray, block_rows: int = BLOCK_ROWS):
        order = np.lexsort((ids, cluster))
        self.ids, self.whole = ids[order], rows[order]
        self.rows = self.whole.astype(np.float64)
        self.starts = cuts(cluster[order], block_rows)
        self.ends = np.r_[self.starts[1:], len(ids)]
        self.high, self.low = (f.reduceat(self.rows, self.starts, axis=0) if len(ids) else self.rows for f in (np.maximum, np.minimum))
        self.scored = self.skipped = 0

    def top(self, queries: np.ndarray, own: np.ndarray, bars: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query, (ids, scores) of the k best records but its own that reach its bar."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in own]
        if not len(self.ids) or not len(own):
            return found
        asked, bars = queries.astype(np.float64), bars.astype(np.int64).copy()
        reach = most(asked, self.high, self.low)
        for b in np.argsort(-reach.max(axis=1), kind="stable"):  # the most promising blocks raise bars
            live = np.flatnonzero(reach[b] >= bars)
            self.skipped += (len(own) - len(live)) * int(self.ends[b] - self.starts[b])
            if len(live):
                self.block(b, live, asked, queries, own, bars, found, k)
        return found

    def block(self, b: int, live: np.ndarray, asked: np.ndarray, queries: np.ndarray,
              own: np.ndarray, bars: np.ndarray, found: list, k: int) -> None:
        """Raises the queries' results and bars with the records of one block."""
        start, end = int(self.starts[b]), int(self.ends[b])
        rows, ids = self.rows[start:end], self.ids[start:end]
        q = asked[live]
        bound = np.maximum(q * self.high[b], q * self.low[b])  # the most each term adds in this block
        size = np.abs(q) * np.maximum(np.abs(self.high[b]), np.abs(self.low[b]))
        order, slack = np.argsort(-size, axis=1, kind="stable"), SLACK * size.sum(axis=1)
        rest = np.take_along_axis(bound, order, axis=1)[:, ::-1].cumsum(axis=1)[:, ::-1]
        rest = np.concatenate([rest, np.zeros((len(live), 1))], axis=1) + slack[:, None]  # bound of all terms from here on
        essential = (rest >= np.maximum(bars[live], 1)[:, None]).sum(axis=1)
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
        gained = rows @ np.where(rank < essential[:, None], q, 0).T  # traversal, for all queries at once
        alive = gained + rest[np.arange(len(live)), essential] >= bars[live]
        for j in np.flatnonzero(alive.any(axis=0)):
            i, at, score = live[j], np.flatnonzero(alive[:, j]), gained[:, j]
            for done in range(essential[j], q.shape[1], PROBE):
                if len(at) <= k:
                    break
                terms = order[j, done:done + PROBE]
                score[at] += rows[np.ix_(at, terms)] @ q[j, terms]
                at = at[score[at] + rest[j, min(done + PROBE, q.shape[1])] >= bars[i]]
            at = at[ids[at] != own[i]]
            self.scored += len(at)
            if len(at):
                exact = products(self.whole[start + at], queries[i])
                keep = exact >= bars[i]
                found[i] = best_of(np.r_[found[i][0], ids[at][keep]], np.r_[found[i][1], exact[keep]], k)
                if len(found[i][0]) == k:
                    bars[i] = max(bars[i], found[i][1][-1])


def top_k(records: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 5,
          shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """``query_id, rank, key, score``: for each query the k records of highest inner product,
    all if there are fewer, ties to the smaller key; never the query's own key.

    ``vector`` holds whole numbers (array of long) whose products fit 64 bits. Rows whose key or
    vector is null, or whose vector holds null, take no part; empty vectors neither. Vectors meet
    those of their own length, each length is searched by itself. Repeated rows count once, and
    of an id with several vectors the best counts.

    Clusters are fitted on at most 8,192 records, which also give the bars; at most 512 rows of
    largest and smallest entries, over all records, decide where queries go. Shards and blocks of
    queries are bounded, and a shard meets only the blocks that have a query for it. The window
    that merges shards keeps k rows a query before its shuffle.
    """
    def clean(df):
        return df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vec")).filter(
            "id is not null and vec is not null and size(vec) > 0 and not exists(vec, x -> x is null)").distinct()

    records, queries = cut_lineage(clean(records)), cut_lineage(clean(queries))
    out = None
    for d in sorted(r.d for r in records.select(F.size("vec").alias("d")).distinct().collect()):
        part = _top_k(records.filter(F.size("vec") == d), queries.filter(F.size("vec") == d), d, k, shard_rows, block_queries)
        out = part if out is None else out.union(part)
    if out is None:
        return records.sparkSession.createDataFrame([], "query_id long, rank int, key long, score long")
    return out


def _top_k(records: DataFrame, queries: DataFrame, d: int, k: int, shard_rows: int, block_queries: int) -> DataFrame:
    first = records.orderBy(F.xxhash64("id", F.lit(4)), "id").limit(SAMPLE).toPandas()
    ids, held = first["id"].to_numpy(), np.stack(first["vec"].to_numpy()).astype(np.int64)
    centres = fit_codes(held.astype(np.float64), max(1, min(CLUSTERS, len(held) // 16)))
    coarse = fit_codes(centres, max(1, len(centres) // 16))  # similar clusters get neighbouring numbers
    centres = centres[((centres[:, None, :] - coarse) ** 2).sum(axis=2).argmin(axis=1).argsort(kind="stable")]

    def cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column("vec"), d).astype(np.float64)
            near = ((centres * centres).sum(axis=1) - 2 * rows @ centres.T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int64))], names=["id", "vec", "cell"])

    schema = "id long, vec array<long>, cell long"
    records, asks = cut_lineage(records.mapInArrow(cluster, schema)), queries.mapInArrow(cluster, schema)

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a cluster and task: how many records, their largest and smallest entries."""
        seen: dict[int, list] = {}
        for batch in batches:
            rows, cells = matrix(batch.column("vec"), d), batch.column("cell").to_numpy()
            for c in np.unique(cells).tolist():
                own = rows[cells == c]
                n, high, low = seen.get(c, (0, own[0], own[0]))
                seen[c] = [n + len(own), np.maximum(high, own.max(axis=0)), np.minimum(low, own.min(axis=0))]
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.int64()), pa.array([x[0] for x in seen.values()], pa.int64()),
             pa.array([x[1].tolist() for x in seen.values()], kind), pa.array([x[2].tolist() for x in seen.values()], kind)],
            names=["cell", "n", "high", "low"])

    partial = records.mapInArrow(extremes, "cell long, n long, high array<long>, low array<long>")
    entries = [f(F.col("high" if f is F.max else "low")[i]).alias(f"{'h' if f is F.max else 'l'}{i}") for f in (F.max, F.min) for i in range(d)]
    stats = partial.groupBy("cell").agg(F.sum("n").alias("n"), F.array(*entries[:d]).alias("high"), F.array(*entries[d:]).alias("low")).collect()
    shards = deal({r.cell: r.n for r in stats}, shard_rows)
    blocks = deal({r.cell: r["count"] for r in asks.groupBy("cell").count().collect()}, block_queries)
    high, low = (np.array([r[c] for r in stats], np.float64).reshape(-1, d) for c in ("high", "low"))
    parts = [np.arange(a, a + n) for a, n in (shards[r.cell] for r in stats)]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each shard that can hold one of a query's k best, with the query's bar."""
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            own, vecs = batch.column("id").to_numpy(), matrix(batch.column("vec"), d)
            scores = products(held, vecs.T)
            bars = np.full(len(own), NONE)
            for j in range(len(own)):
                other = np.flatnonzero(ids != own[j])
                if len(other) > 64 * k:
                    other = other[np.argpartition(-scores[other, j], 64 * k)[:64 * k]]
                top = best_of(ids[other], scores[other, j], k)[1]
                bars[j] = top[-1] if len(top) == k else NONE
            reached = most(vecs.astype(np.float64), high, low) >= bars
            to = [np.unique(np.concatenate([parts[c] for c in np.flatnonzero(reached[:, j])] or [np.zeros(0, np.int64)])) for j in range(len(own))]
            pick = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in to]))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(pick) for c in ("id", "vec", "block")], pa.array(bars).take(pick),
                 pa.array(np.concatenate(to) if to else np.zeros(0, np.int64))], names=["id", "vec", "block", "bar", "shard"])

    sent = cut_lineage(placed(asks, blocks, "block").select("id", "vec", "block").mapInArrow(
        route, "id long, vec array<long>, block long, bar long, shard long"))
    held_by = placed(records, shards, "shard").join(sent.select("shard", "block").distinct(), "shard")
    met = held_by.select("shard", "block", "id", "vec", "cell", F.lit(None).cast("long").alias("bar")).union(
        sent.select("shard", "block", "id", "vec", F.lit(None).cast("long").alias("cell"), "bar"))

    def run(rows: pa.Table) -> pa.Table:
        asks = rows.column("bar").is_valid().to_numpy()
        own, asked = rows.filter(pa.array(~asks)), rows.filter(pa.array(asks))
        shard = Shard(own.column("id").to_numpy(), matrix(own.column("vec"), d), own.column("cell").to_numpy())
        names = asked.column("id").to_numpy()
        found = shard.top(matrix(asked.column("vec"), d), names, asked.column("bar").to_numpy(), k)
        return pa.table({"query_id": np.repeat(names, [len(x) for x, _ in found]),
                         "id": np.concatenate([x for x, _ in found] or [np.zeros(0, np.int64)]),
                         "score": np.concatenate([x for _, x in found] or [np.zeros(0, np.int64)])})

    best = met.groupBy("shard", "block").applyInArrow(run, "query_id long, id long, score long")
    once = best.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    turn = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (once.withColumn("rank", F.row_number().over(turn)).filter(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias("key"), "score"))
