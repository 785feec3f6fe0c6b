"""Hard negatives through an inverted multi-index.

Vectors are cut in two halves, each with a codebook; a pair of codes is a cell. A half code's
bound on a half score is the anchor's product with the code plus the length of its own half times
the radius of that code, the farthest that any row is from it. A heap walks the pairs of codes in
order of the sum of both bounds (multi-sequence), so once that sum is below the last place of
every window asked for, nothing later can enter it: the windows are certified and the walk stops.

Rows are dealt to shards by cell and anchors to blocks by their own cell. A bounded sample gives
every window a first bar, and an anchor is sent only to shards that hold a cell above it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .rotation_codes import matrix

SAMPLE = 8192
CODES = 32
ROUNDS = 6
SHARD_ROWS = 2048
BLOCK_ANCHORS = 1024
STEP = 256
NONE = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Books:
    """A codebook for each half of vectors of whole numbers."""

    codes: tuple[np.ndarray, np.ndarray]

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.codes[0].shape[1]
        return x[:, :cut], x[:, cut:]

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest code, distance to it) of each half, as two columns."""
        number, far = np.zeros((len(x), 2), np.int64), np.zeros((len(x), 2))
        for h, (part, codes) in enumerate(zip(self.halves(x), self.codes)):
            near = (codes * codes).sum(axis=1) - 2 * part @ codes.T
            number[:, h] = near.argmin(axis=1)
            far[:, h] = np.sqrt(((part - codes[number[:, h]]) ** 2).sum(axis=1))
        return number, far

    def bounds(self, query: np.ndarray, radii: np.ndarray) -> list[np.ndarray]:
        """Per half: the most a row of each code can score in it. Unused codes have radius -1."""
        out = []
        for h, part in enumerate(self.halves(query[None])):
            length = np.sqrt((part * part).sum())
            far = radii[h][:len(self.codes[h])]
            top = self.codes[h] @ part[0] + length * far * (1 + 1e-9) + 1e-6
            out.append(np.where(far < 0, -np.inf, top))
        return out

    def cell_bounds(self, query: np.ndarray, cells: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """The most that a row of each cell can score; ``reach``: radii of the cell's halves."""
        top = np.full(len(cells), 1e-6)
        for h, (part, number) in enumerate(zip(self.halves(query[None]), (cells // CODES, cells % CODES))):
            top += (self.codes[h] @ part[0])[number] + np.sqrt((part * part).sum()) * reach[:, h] * (1 + 1e-9)
        return top


def fit_codes(sample: np.ndarray, codes: int, seed: int = 11) -> np.ndarray:
    """Centres of ``sample`` by a few rounds of k-means."""
    if not sample.shape[1]:
        return np.zeros((1, 0))
    distinct = np.unique(sample, axis=0)
    centres = distinct[np.random.default_rng(seed).choice(len(distinct), min(codes, len(distinct)), replace=False)]
    for _ in range(ROUNDS):
        own = ((centres * centres).sum(axis=1) - 2 * sample @ centres.T).argmin(axis=1)
        sums, count = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, sample)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def fit_books(sample: np.ndarray, codes: int = CODES) -> Books:
    cut = max(1, sample.shape[1] // 2)
    return Books((fit_codes(sample[:, :cut], codes), fit_codes(sample[:, cut:], codes)))


def walk(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(bound, code, code) of all pairs of used codes, by falling sum of their bounds."""
    a, b = (np.argsort(-x, kind="stable")[:int(np.isfinite(x).sum())] for x in (first, second))
    if not len(a) or not len(b):
        return
    heap, seen = [(-(first[a[0]] + second[b[0]]), 0, 0)], {(0, 0)}
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield -bound, int(a[i]), int(b[j])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (-(first[a[x]] + second[b[y]]), x, y))


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers (``query``: one, or one a column): in double precision
    where that is exact."""
    most = float(np.abs(rows).max(initial=0)) * float(np.abs(query).max(initial=0)) * max(1, len(query))
    if most < 2 ** 53:
        return (rows.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    return rows.astype(np.int64) @ query.astype(np.int64)


@dataclass
class Asked:
    """A window that an anchor asks for: scores from ``low`` to ``high``, of rows that share the
    anchor's label or do not, the first ``k``. ``bar``: nothing below it can be among them."""

    low: int
    high: int
    bar: int
    same: bool
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def take(self, ids: np.ndarray, scores: np.ndarray, alike: np.ndarray, k: int) -> None:
        fits = (scores >= max(self.low, self.bar)) & (scores <= self.high) & (alike if self.same else ~alike)
        if not fits.any():
            return
        ids, scores = np.r_[self.ids, ids[fits]], np.r_[self.scores, scores[fits]]
        best = np.lexsort((ids, -scores))[:k]
        self.ids, self.scores = ids[best], scores[best]
        if len(best) == k:
            self.bar = max(self.bar, int(self.scores[-1]))

    def certified(self, bound):
        """Can nothing of at most ``bound`` enter any more? Equal scores still can, by their id."""
        return bound < max(self.low, self.bar)


class Index:
    """Rows by cell."""

    def __init__(self, books: Books, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray,
                 number: np.ndarray, far: np.ndarray):
        cell = number[:, 0] * CODES + number[:, 1]
        order = np.argsort(cell, kind="stable")
        self.books, self.ids, self.labels = books, ids[order], labels[order]
        self.whole, self.rows = rows[order], rows[order].astype(np.float64)
        cells, first = np.unique(cell[order], return_index=True)
        self.at = dict(zip(cells.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(order)])))
        self.radii = np.full((2, CODES), -1.0)
        for h in range(2):
            np.maximum.at(self.radii[h], number[:, h], far[:, h])
        self.top = float(np.abs(rows).max(initial=0))
        self.probed = 0

    def search(self, query: np.ndarray, own: int, label: int, asked: list[Asked], k: int) -> None:
        """Fills the windows asked for from the rows here, in order of the walk."""
        exact = self.top * float(np.abs(query).max(initial=0)) * max(1, len(query)) < 2 ** 53
        as_float, parts, size = query.astype(np.float64), [], 0

        def score():
            at = np.concatenate([np.arange(a, b) for a, b in parts])
            scores = (self.rows[at] @ as_float).astype(np.int64) if exact else self.whole[at] @ query
            other = self.ids[at] != own
            self.probed += len(at)
            for x in asked:
                x.take(self.ids[at][other], scores[other], (self.labels[at] == label)[other], k)

        for bound, i, j in walk(*self.books.bounds(as_float, self.radii)):
            if all(x.certified(bound) for x in asked):
                break
            if (found := self.at.get(i * CODES + j)) is not None:
                parts.append(found)
                size += found[1] - found[0]
                if size >= STEP:
                    score()
                    parts, size = [], 0
        if parts:
            score()


def deal(counts: Mapping[int, int], limit: int) -> dict[int, tuple[int, int]]:
    """cell -> (first part, number of parts): neighbouring small cells share a part of about
    ``limit``, a larger cell is cut in several of its own."""
    out, part, held = {}, 0, 0
    for cell in sorted(counts):
        n = counts[cell]
        if held and held + n > limit:
            part, held = part + 1, 0
        if n > limit:
            out[cell] = (part, -(-n // limit))
            part, held = part + out[cell][1], 0
        else:
            out[cell] = (part, 1)
            held += n
    return out


def placed(df: DataFrame, parts: Mapping[int, tuple[int, int]], name: str) -> DataFrame:
    """``df`` with the part of each row. The table has a row a cell, at most ``CODES ** 2``."""
    rows = [(c, a, n) for c, (a, n) in parts.items()]
    known = df.sparkSession.createDataFrame(rows, "cell long, _first long, _n long")
    return df.join(F.broadcast(known), "cell").withColumn(
        name, F.col("_first") + F.pmod(F.xxhash64("id", F.lit(9)), F.col("_n"))).drop("_first", "_n")


def windows(rows: DataFrame, asks: DataFrame, books: Books, sample: tuple[np.ndarray, ...], d: int, k: int,
            shard_rows: int, block_anchors: int) -> DataFrame:
    """``ask, id, rank, score``: the first ``k`` rows of each window, ties to the smaller id.

    ``rows``: id, label, vec, cell, far (coded and written). ``asks``: ask, id, label, vec, cell
    of the anchor, same, low, high.
    """
    stats = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far1").alias("a"), F.max("far2").alias("b")).collect()
    shards = deal({r.cell: r.n for r in stats}, shard_rows)
    blocks = deal({r.cell: r["count"] for r in asks.select("id", "cell").distinct().groupBy("cell").count().collect()}, block_anchors)
    cells = np.array([r.cell for r in stats], np.int64)
    reach = np.array([[r.a, r.b] for r in stats]).reshape(-1, 2)
    first = np.array([shards[c][0] for c in cells.tolist()], np.int64)
    many = np.array([shards[c][1] for c in cells.tolist()], np.int64)
    ids, labels, held = sample

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each shard that an ask has to see, with its first bar."""
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            col = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("id", "label", "same", "low", "high")}
            vecs, pick, shard, bars = matrix(batch.column("vec"), d), [], [], []
            for at, (query, scores) in enumerate(zip(vecs, products(held, vecs.T).T)):
                x = Asked(int(col["low"][at]), int(col["high"][at]), NONE, bool(col["same"][at]))
                other = ids != col["id"][at]
                x.take(ids[other], scores[other], (labels == col["label"][at])[other], k)
                wanted = np.flatnonzero(~x.certified(books.cell_bounds(query.astype(np.float64), cells, reach)))
                to = [np.arange(first[c], first[c] + many[c]) for c in wanted]
                to = np.unique(np.concatenate(to)) if to else np.zeros(0, np.int64)
                pick.append(np.full(len(to), at))
                shard.append(to)
                bars.append(np.full(len(to), x.bar))
            pick = pa.array(np.concatenate(pick) if pick else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n).take(pick) for n in ("ask", "id", "label", "vec", "same", "low", "high", "block")],
                 pa.array(np.concatenate(bars) if bars else np.zeros(0, np.int64)),
                 pa.array(np.concatenate(shard) if shard else np.zeros(0, np.int64))],
                names=["ask", "id", "label", "vec", "same", "low", "high", "block", "bar", "shard"])

    columns = "ask long, id long, label int, vec array<long>, same boolean, low long, high long, block long"
    names = [x.split()[0] for x in columns.split(", ")]
    sent = cut_lineage(placed(asks, blocks, "block").select(*names).mapInArrow(route, columns + ", bar long, shard long"))
    pairs = sent.select("shard", "block").distinct()
    empty = F.lit(None)
    own = placed(rows, shards, "shard").join(pairs, "shard").select(
        "shard", "block", "id", "label", "vec", "cell", "far1", "far2", empty.cast("long").alias("ask"),
        empty.cast("boolean").alias("same"), *[empty.cast("long").alias(c) for c in ("low", "high", "bar")])
    both = own.union(sent.select(
        "shard", "block", "id", "label", "vec", *[empty.cast(t).alias(c) for c, t in (("cell", "long"), ("far1", "double"), ("far2", "double"))],
        "ask", "same", "low", "high", "bar"))

    def run(met: pa.Table) -> pa.Table:
        asking = met.column("ask").is_valid().to_numpy()
        held, asked = met.filter(pa.array(~asking)), met.filter(pa.array(asking)).sort_by([("id", "ascending"), ("ask", "ascending")])
        cell = held.column("cell").to_numpy()
        index = Index(books, held.column("id").to_numpy(), held.column("label").to_numpy(), matrix(held.column("vec"), d),
                      np.stack([cell // CODES, cell % CODES], axis=1),
                      np.stack([held.column("far1").to_numpy(), held.column("far2").to_numpy()], axis=1))
        ids, labels, vecs = asked.column("id").to_numpy(), asked.column("label").to_numpy(), matrix(asked.column("vec"), d)
        ask, same, low, high, bar = (asked.column(c).to_numpy() for c in ("ask", "same", "low", "high", "bar"))
        starts = np.flatnonzero(np.r_[True, np.diff(ids) != 0]) if len(ids) else []
        out: list[tuple[np.ndarray, ...]] = []
        for a, b in zip(starts, [*starts[1:], len(ids)]):
            windows = [Asked(int(low[i]), int(high[i]), int(bar[i]), bool(same[i])) for i in range(a, b)]
            index.search(vecs[a], ids[a], labels[a], windows, k)
            out += [(np.full(len(w.ids), ask[i]), w.ids, w.scores) for i, w in zip(range(a, b), windows)]
        done = [np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out) if out else ([],) * 3)]
        return pa.table(dict(zip(("ask", "id", "score"), done)))

    found = both.groupBy("shard", "block").applyInArrow(run, "ask long, id long, score long")
    turn = Window.partitionBy("ask").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(turn)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, key: str, vector: str, label: str, anchor: Column, positives: int = 5,
                   negatives: int = 10, low: int = 30, high: int = 90, codes: int = CODES,
                   shard_rows: int = SHARD_ROWS, block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vector`` holds whole numbers (array of long) whose inner products fit 64 bits; ``label`` is
    whole. An anchor (where the condition ``anchor`` holds) has as positives the first
    ``positives`` other rows of its label, by falling score, ties to the smaller key. For each,
    the first ``negatives`` rows of other labels whose score is from ``low`` to ``high`` percent
    of the positive's are returned. All are if there are fewer.

    Rows with a null key, label, vector or component take no part. Of a repeated key the smallest
    (label, vector) counts. Vectors meet those of their own length only; each length is searched
    by itself. The codebooks are fitted on at most 8,192 rows; every row is indexed, and bounds
    use the exact radii of all rows, so results do not depend on the sample. Where data has no
    clusters no bound is sharp, and nearly all rows are scored.
    """
    if codes > CODES:
        raise ValueError(f"at most {CODES} codes a half")
    base = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("int").alias("label"),
                          F.col(vector).cast("array<long>").alias("vec"), F.coalesce(anchor, F.lit(False)).alias("asks"))
    usable = "id is not null and label is not null and vec is not null and size(vec) > 0 and not exists(vec, x -> x is null)"
    once = base.filter(usable).groupBy("id").agg(F.min(F.struct("label", "vec", "asks")).alias("r"))
    clean = cut_lineage(once.select("id", "r.label", "r.vec", "r.asks"))
    out = None
    for d in sorted(r.d for r in clean.select(F.size("vec").alias("d")).distinct().collect()):
        own = clean.filter(F.size("vec") == d)
        first = own.orderBy(F.xxhash64("id", F.lit(2)), "id").limit(SAMPLE).toPandas()
        held = np.stack(first["vec"].to_numpy()).astype(np.int64)
        books = fit_books(held.astype(np.float64), codes)
        sample = (first["id"].to_numpy(), first["label"].to_numpy(), held)

        def code(batches: Iterator[pa.RecordBatch], d=d, books=books) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                number, far = books.cells(matrix(batch.column("vec"), d).astype(np.float64))
                made = [pa.array(number[:, 0] * CODES + number[:, 1]), pa.array(far[:, 0]), pa.array(far[:, 1])]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "cell", "far1", "far2"])

        rows = cut_lineage(own.mapInArrow(
            code, "id long, label int, vec array<long>, asks boolean, cell long, far1 double, far2 double"))
        anchors = rows.filter("asks").select("id", "label", "vec", "cell")
        wide = anchors.select(F.col("id").alias("ask"), "*", F.lit(True).alias("same"),
                              F.lit(NONE).alias("low"), F.lit(np.iinfo(np.int64).max).alias("high"))
        good = cut_lineage(windows(rows, wide, books, sample, d, positives, shard_rows, block_anchors).select(
            F.col("ask").alias("anchor_id"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"),
            F.monotonically_increasing_id().alias("ask")))
        score = F.col("positive_score")
        asks = good.join(anchors, good["anchor_id"] == anchors["id"]).select(
            "ask", "id", "label", "vec", "cell", F.lit(False).alias("same"),
            F.expr(f"({low} * positive_score) div 100 + if(({low} * positive_score) % 100 > 0, 1, 0)").alias("low"),
            F.expr(f"({high} * positive_score) div 100 - if(({high} * positive_score) % 100 < 0, 1, 0)").alias("high")
        ).filter("low <= high")
        bad = windows(rows, asks, books, sample, d, negatives, shard_rows, block_anchors)
        part = bad.withColumnRenamed("score", "negative_score").withColumnRenamed("id", "negative_id").join(
            good, "ask").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
                                score.alias("positive_score"), "negative_score")
        out = part if out is None else out.union(part)
    if out is None:
        return vectors.sparkSession.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out
