"""What the search for linked vectors writes, and its sums over pairs of tiles."""

import numpy as np
import pytest
from test_neighbours import brute_links, roots

from lodestone.llm import rotation_codes


def test_nothing_written_grows_with_the_pairs(spark, monkeypatch):
    written, write = [], rotation_codes.cut_lineage

    def noted(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        written.append((plan, write(df)))
        return written[-1][1]

    monkeypatch.setattr(rotation_codes, "cut_lineage", noted)
    monkeypatch.setattr(rotation_codes, "CELL_ROWS", 32)
    rng = np.random.default_rng(5)
    data = [(k, v.tolist()) for k, v in enumerate(rng.standard_normal((1000, 16)))]
    got = {r.key: (r.n_links, r.component) for r in rotation_codes.linked(
        spark.createDataFrame(data, "id long, v array<double>"), "id", "v").collect()}
    assert got == brute_links(data)
    assert all(t.count() <= 1000 for _, t in written)  # every vector was written once a cell before
    assert not any("FlatMapGroupsInArrow" in plan and "Generate" in plan for plan, _ in written)
    assert any("CartesianProduct" in plan and "Exchange" not in plan for plan, _ in written)


@pytest.mark.parametrize("held", [1, 1 << 20])
def test_found_links_are_summed_an_id_once(monkeypatch, held):
    monkeypatch.setattr(rotation_codes, "HELD", held)
    rng, found = np.random.default_rng(2), rotation_codes.Found()
    want, links = np.zeros(100, np.int64), []
    for _ in range(20):
        ids = rng.choice(100, 30, replace=False)
        n, (child, root) = rng.integers(0, 3, 30), rng.integers(0, 100, (2, 3))
        want[ids] += n
        links += list(zip(child, root))
        found.add(ids, n, child, root)
    rows = [r for b in found.batches() for r in zip(*(c.to_pylist() for c in b.columns))]
    sums = {u: n for u, v, n in rows if u == v}
    assert sums == {i: n for i, n in enumerate(want) if n}
    edges = [(u, v) for u, v, n in rows if u != v]
    assert roots(100, edges) == roots(100, links) and len(edges) < 100
    assert list(rotation_codes.Found().batches()) == []


def test_a_confidence_bound_is_asked_from_both_sides():
    rng = np.random.default_rng(4)
    near = rng.standard_normal((30, 8))
    x = rotation_codes.unit(np.r_[near, near + 0.1 * rng.standard_normal((30, 8))])
    turn = rotation_codes.rotation(8)

    def tile(k, at):
        codes, factor = rotation_codes.encode(x[at], turn)
        row = {"tile": k, "cell": 0, "ids": at, "copies": np.ones(len(at), np.int64), "vecs": x[at], "codes": codes,
               "factors": factor, "reach": np.full((len(at), 1), 128, np.uint8)}
        return rotation_codes.Tile({c: v.tobytes() if isinstance(v, np.ndarray) else v for c, v in row.items()}, 8)

    tiles, whole = [tile(0, np.arange(0, 60, 2)), tile(1, np.arange(1, 60, 2))], tile(0, np.arange(60))
    for width in (None, 0.5):
        parts, one = rotation_codes.Found(), rotation_codes.Found()
        for a, b in ((0, 0), (0, 1), (1, 1)):
            rotation_codes.tile_links(tiles[a], tiles[b], parts, 0.95, width, turn)
        rotation_codes.tile_links(whole, whole, one, 0.95, width, turn)
        got, want = ([{u: n for u, v, n in zip(*(c.to_pylist() for c in b.columns)) if u == v} for b in f.batches()]
                     for f in (parts, one))
        assert got == want and sum(want[0].values()) > 0
