"""Embedding near-duplicates through binary codes of randomly rotated vectors.

A unit vector o is rotated and kept as the signs of its components, the corner x of a cube on
the sphere, with its correction factor c = <o, x>. For a unit vector q, <x, q> / c estimates
<o, q> without bias; the error is tan(angle of o and x) * sqrt(1 - <o, q>^2) * <g, q'> for a
direction g that is random under the rotation, so |<g, q'>| is about 1 / sqrt(d - 1), and never
above 1. The bound says which pairs can reach the threshold: those are computed exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import skewed_join
from ..session import cut_lineage
from .common import components, small_batches, unite

SAMPLE = 16_384
CELL_ROWS = 4096
LEAST_ROWS = 256  # of a tile, where vectors are long
TILE_BYTES = 1 << 22
HELD = 1 << 20  # links and edges a task holds before it sums them up
CELLS = 1024
ROUNDS = 5
SEED = 7


def usable(vector: Column) -> Column:
    """Not null, not zero, all components there and finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def vector_hash() -> Column:
    """128 bits of ``vec``, a name for equal vectors that is narrower than they are: two hashes
    that begin from seeds of their own."""
    return F.struct(F.xxhash64(F.lit(1), "vec").alias("a"), F.xxhash64(F.lit(2), "vec").alias("b"))


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision. Scaled first, so that no square overflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def encode(units: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed signs, correction factor) of unit vectors."""
    turned = units @ turn
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(units.shape[1])


def corners(codes: np.ndarray, d: int) -> np.ndarray:
    return (np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(d))


def least_estimate(factor: np.ndarray, threshold: float, d: int, width: float | None) -> np.ndarray:
    """The least <x, q> at which the pair can still reach the threshold.

    ``width``: half the confidence interval in units of 1 / sqrt(d - 1). None takes the bound
    that always holds, sqrt(d - 1), so no pair is lost.
    """
    reach = 1.0 if width is None else min(1.0, width / np.sqrt(max(1, d - 1)))
    slack = np.sqrt(np.maximum(0, 1 - factor ** 2)) * np.sqrt(1 - threshold ** 2) * reach
    return factor * threshold - slack - 1e-5


def fit_centres(sample: np.ndarray, cells: int, seed: int = SEED) -> np.ndarray:
    """Centres by a few rounds of spherical k-means."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        own = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-12), centres)
    return centres


def matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def compare_block(home: np.ndarray, home_id: np.ndarray, home_copies: np.ndarray, other: np.ndarray,
                  other_id: np.ndarray, copies: np.ndarray, codes: np.ndarray, factor: np.ndarray,
                  threshold: float, width: float | None, turn: np.ndarray, rows: int = 512):
    """Links of home vectors to others: (links of each home vector, copies of the others counted;
    links of each other vector, home copies counted; child and parent ids of a forest over the
    linked). Codes decide, exact cosines confirm."""
    d = home.shape[1]
    ids, index = np.unique(np.r_[home_id, other_id], return_inverse=True)
    at_home, at_other = index[:len(home_id)], index[len(home_id):]
    parent, links, back = np.arange(len(ids)), np.zeros(len(home_id), np.int64), np.zeros(len(other_id), np.int64)
    signs = corners(codes, d).T.copy()
    floor = least_estimate(factor, threshold, d, width).astype(np.float32)
    turned = (home @ turn).astype(np.float32)
    for at in range(0, len(home), rows):
        i, j = np.nonzero(turned[at:at + rows] @ signs >= floor)
        i += at
        apart = at_home[i] != at_other[j]
        i, j = i[apart], j[apart]
        for k in range(0, len(i), 1 << 16):
            a, b = i[k:k + (1 << 16)], j[k:k + (1 << 16)]
            near = np.einsum("nd,nd->n", home[a], other[b]) >= threshold
            a, b = a[near], b[near]
            links += np.bincount(a, weights=copies[b], minlength=len(links)).astype(np.int64)
            back += np.bincount(b, weights=home_copies[a], minlength=len(back)).astype(np.int64)
            parent = unite(parent, at_home[a], at_other[b])
    child = np.flatnonzero(parent != np.arange(len(ids)))
    return links, back, ids[child], ids[parent[child]]


class Found:
    """What a task has found in its pairs of tiles, an id once: its links are summed, and of the
    pairs of linked ids a forest is kept. Memory follows the ids that the task has met."""

    def __init__(self):
        self.links, self.edges, self.room = [], [], HELD

    def add(self, ids: np.ndarray, links: np.ndarray, child: np.ndarray, root: np.ndarray) -> None:
        some = np.flatnonzero(links)
        self.links.append((ids[some], links[some]))
        self.edges.append((child, root))
        if self.size() > self.room:
            self.fold()
            self.room = max(HELD, 2 * self.size())

    def size(self) -> int:
        return sum(len(a) for a, _ in self.links) + sum(len(a) for a, _ in self.edges)

    def fold(self) -> None:
        ids, n = (np.concatenate(x) for x in zip(*self.links))
        ids, at = np.unique(ids, return_inverse=True)
        self.links = [(ids, np.bincount(at, weights=n, minlength=len(ids)).astype(np.int64))]
        child, root = (np.concatenate(x) for x in zip(*self.edges))
        ids, at = np.unique(np.r_[child, root], return_inverse=True)
        parent = unite(np.arange(len(ids)), at[:len(child)], at[len(child):])
        child = np.flatnonzero(parent != np.arange(len(ids)))
        self.edges = [(ids[child], ids[parent[child]])]

    def batches(self) -> Iterator[pa.RecordBatch]:
        """``u, v, n``: links ``n`` of an id where ``u`` and ``v`` are the same, else an edge."""
        if not self.links:
            return
        self.fold()
        (ids, n), (child, root) = self.links[0], self.edges[0]
        u, v, n = np.r_[ids, child], np.r_[ids, root], np.r_[n, np.zeros(len(child), np.int64)]
        for at in range(0, len(u), 1 << 16):
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[at:at + (1 << 16)].astype(np.int64)) for x in (u, v, n)], names=["u", "v", "n"])


class Tile:
    """A row of the table of tiles, its columns read back as arrays."""

    def __init__(self, row: dict, d: int, suffix: str = ""):
        self.tile, self.cell = row["tile" + suffix], row["cell" + suffix]
        self.ids, self.copies = (np.frombuffer(row[c + suffix], np.int64) for c in ("ids", "copies"))
        self.factor = np.frombuffer(row["factors" + suffix], np.float64)
        n, vecs = len(self.ids), row["vecs" + suffix]
        self.units = unit(np.frombuffer(vecs, f"f{len(vecs) // (n * d)}").reshape(n, d))
        self.codes, self.reach = (np.frombuffer(row[c + suffix], np.uint8).reshape(n, -1) for c in ("codes", "reach"))

    def entering(self, cell: int) -> np.ndarray:
        """Places of the vectors that enter a cell."""
        return np.flatnonzero(self.reach[:, cell >> 3] >> (7 - (cell & 7)) & 1)


def tile_links(a: Tile, b: Tile, found: Found, threshold: float, width: float | None, turn: np.ndarray) -> None:
    """Compares those vectors of two tiles that enter each other's cell. The bound that always
    holds loses no pair from either side, so one side's codes do; a confidence bound may, so there
    each side is asked."""
    i, j = a.entering(b.cell), b.entering(a.cell)
    sides = [(a, i, b, j)] if width is None or a.tile == b.tile else [(a, i, b, j), (b, j, a, i)]
    for x, i, y, j in sides:
        links, back, child, root = compare_block(
            x.units[i], x.ids[i], x.copies[i], y.units[j], y.ids[j], y.copies[j], y.codes[j], y.factor[j],
            threshold, width, turn)
        found.add(x.ids[i], links, child, root)
        if width is None and a.tile != b.tile:
            found.add(y.ids[j], back, child[:0], root[:0])


def linked(vectors: DataFrame, key: str, vector: str, threshold: float = 0.95,
           width: float | None = None) -> DataFrame:
    """``key, n_links, component`` for every row: how many other rows have a cosine of at least
    ``threshold``, and the smallest key reachable by such links, its own included.

    Unusable vectors link with nothing. Vectors meet those of their own length, each length is
    searched by itself. Rows of a repeated key are rows like any other, and a null key names no
    component unless all are null. Equal vectors are one node with a number of copies.

    Centres fitted on at most 16,384 vectors give each a home cell. A vector also enters every
    cell whose border is no farther than linked vectors can be apart, so linked vectors enter each
    other's home cells. Cells are cut in tiles of about 4,096 vectors, whatever their size, and a
    vector is written once, in its own tile. Codes and factors are made once. Pairs of tiles are
    formed where the table of tiles is read, so nothing on disk grows with the pairs, and a task
    sums up what it finds. Copies of one vector, and rows of a large component, are spread in the
    joins that name them. Where data has no clusters every cell is a neighbour and the pairs of
    tiles cover all pairs; nothing is left out to avoid that.
    """
    base = vectors.select(F.col(key).alias("key"), F.when(usable(F.col(vector)), F.col(vector)).alias("vec"))
    named = base.select("key", F.when(F.col("vec").isNotNull(), vector_hash()).alias("hash"))
    nodes = cut_lineage(base.filter("vec is not null").groupBy("vec").agg(
        F.min("key").alias("least"), F.count(F.lit(1)).alias("copies"))
        .select("*", vector_hash().alias("hash"), F.monotonically_increasing_id().alias("id")))
    found = None
    for d in sorted(r.d for r in nodes.select(F.size("vec").alias("d")).distinct().collect()):
        part = _linked(nodes.filter(F.size("vec") == d), d, threshold, width)
        found = part if found is None else found.union(part)
    if found is None:
        return base.select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component"))
    return skewed_join(named, found, "hash", F.col("key"), "left").select(
        "key", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("key")).otherwise(F.col("component")).alias("component"))


def _linked(nodes: DataFrame, d: int, threshold: float, width: float | None) -> DataFrame:
    """``hash, n_links, component`` of different vectors of one length."""
    total = nodes.count()
    cells = min(CELLS, -(-total // CELL_ROWS))
    sample = nodes.orderBy("hash").limit(SAMPLE).select("vec").toPandas()["vec"]
    centres = fit_centres(unit(np.stack(sample.to_numpy())), cells)
    turn, gap = rotation(d), np.sqrt(2 - 2 * threshold)
    apart = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))

    value = 4 if nodes.schema["vec"].dataType.elementType.typeName() == "float" else 8
    most = min(CELL_ROWS, max(LEAST_ROWS, TILE_BYTES // (value * d)))

    def parts(batches: Iterator[pa.RecordBatch]):
        """(rows, their home cells, which cells each enters), 2,048 rows at a time."""
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                near = unit(matrix(part.column(0), d)) @ centres.T
                home = near.argmax(axis=1)
                yield part, home, near.max(axis=1, keepdims=True) - near <= gap * apart[home] + 1e-9

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, home, _ in parts(batches):
            cell, n = np.unique(home, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(n.astype(np.int64))], names=["cell", "n"])

    tiles_of = np.ones(len(centres), np.int64)  # a row a cell: 1,024 at most
    for r in nodes.select("vec").mapInArrow(homes, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        tiles_of[r.cell] = -(-r.n // most)
    first = np.cumsum(tiles_of) - tiles_of

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, home, reach in parts(batches):
            spread = part.column(1).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
            tile = first[home] + (spread % tiles_of[home].astype(np.uint64)).astype(np.int64)
            entered = pa.array([r.tobytes() for r in np.packbits(reach, axis=1)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(tile), pa.array(home.astype(np.int32)), *part.columns, entered],
                names=["tile", "cell", "vec", "id", "copies", "reach"])

    def pack(rows: pa.Table) -> pa.Table:
        vecs = matrix(rows.column("vec"), d)
        vecs = vecs if vecs.dtype == np.float32 else vecs.astype(np.float64)
        codes, factor = encode(unit(vecs), turn)
        reach = np.frombuffer(b"".join(rows.column("reach").to_pylist()), np.uint8).reshape(len(vecs), -1)
        enters = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(reach, axis=0), count=len(centres)))
        blobs = {"ids": rows.column("id").to_numpy(), "copies": rows.column("copies").to_numpy(), "vecs": vecs,
                 "codes": codes, "factors": factor, "reach": reach}
        return pa.table({"tile": rows.column("tile")[:1], "cell": rows.column("cell")[:1],
                         "enters": pa.array([enters.astype(np.int32)], pa.list_(pa.int32())),
                         **{c: pa.array([x.tobytes()], pa.binary()) for c, x in blobs.items()}})

    # as many files as tiles, so that the scan can deal them out
    tiles = cut_lineage(
        nodes.select("vec", "id", "copies").mapInArrow(
            enter, f"tile long, cell int, vec {nodes.schema['vec'].dataType.simpleString()}, id long, copies long, reach binary")
        .repartition(int(tiles_of.sum()), "tile").groupBy("tile").applyInArrow(
            pack, "tile long, cell int, enters array<int>, ids binary, copies binary, vecs binary, codes binary, "
                  "factors binary, reach binary"))
    others = tiles.toDF(*[f"{c}_2" for c in tiles.columns])
    # each two tiles once, and every tile first in about half of its pairs
    even = F.pmod(F.col("tile") + F.col("tile_2"), F.lit(2)) == 0
    once = (F.col("tile") == F.col("tile_2")) | ((F.col("tile") < F.col("tile_2")) == even) & (F.col("tile") != F.col("tile_2"))
    pairs = tiles.join(others.hint("shuffle_replicate_nl"), once & F.array_contains("enters", F.col("cell_2"))
                       & F.array_contains("enters_2", F.col("cell"))).drop("enters", "enters_2")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, a = Found(), None
        for batch in batches:
            for row in batch.to_pylist():
                a = a if a is not None and a.tile == row["tile"] else Tile(row, d)
                tile_links(a, a if a.tile == row["tile_2"] else Tile(row, d, "_2"), found, threshold, width, turn)
        yield from found.batches()

    found = cut_lineage(small_batches(pairs).mapInArrow(compare, "u long, v long, n long"))
    counts = found.filter("u = v").groupBy(F.col("u").alias("id")).agg(F.sum("n").alias("n"))
    roots = components(found.filter("u <> v").select("u", "v"))
    rooted = cut_lineage(
        nodes.select("id", "hash", "least", "copies").join(counts, "id", "left")
        .join(roots.withColumnRenamed("node", "id"), "id", "left")
        .select("id", "hash", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                F.coalesce("root", "id").alias("root")))
    names = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return skewed_join(rooted, names, "root", F.col("id")).select("hash", "n_links", "component")
