"""Links between fingerprints and vectors, and exact search, beside brute force."""

import numpy as np
import pytest
import xxhash

from lodestone.llm import common, maxscore, queries, rotation_codes, simhash

FOLDER = "/root/testdata/sf0.001"


def roots(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (330, 2))] + [(i, i + 1) for i in range(400, 460)]
    links += [(500, i) for i in range(501, 600)] * 2
    got = {r.node: r.root for r in common.components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = roots(600, links)
    touched = {x for a, b in links if a != b for x in (a, b)}
    assert got == {i: want[i] for i in touched if want[i] != i}
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_print(text, width):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    import re
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    runs = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def test_simhash_matches_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    docs.sort()
    prints = [brute_print(d.text, 4) for d in docs]
    links = [(i, j) for i in range(len(docs)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    want = {d.doc_id: (f"{p:016x}", docs[r].doc_id) for d, p, r in zip(docs, prints, roots(len(docs), links))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.anchor_simhash(spark, FOLDER).collect()}
    assert got == want


@pytest.mark.parametrize("bits", [0, 3, 4, 5])
def test_anchors_lose_no_link(spark, bits):
    rng = np.random.default_rng(bits)
    fps = rng.integers(-2 ** 63, 2 ** 63 - 1, 300)
    for i in range(300):
        flips = rng.choice(64, rng.integers(0, 8), replace=False)
        fps = np.append(fps, fps[i] ^ np.bitwise_xor.reduce(np.int64(1) << flips.astype(np.int64), initial=np.int64(0)))
    fps = np.unique(fps)
    links = [(i, j) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]) & (2 ** 64 - 1) and
             (int(fps[i] ^ fps[j]) & (2 ** 64 - 1)).bit_count() <= bits]
    want = {int(fps[i]): int(fps[r]) for i, r in enumerate(roots(len(fps), links)) if i != r}
    frame = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    found = simhash.fingerprint_links(frame, bits)
    assert {r.node: r.root for r in common.components(found).collect()} == want


def test_simhash_odd_rows(spark):
    rows = [(5, None, "a"), (3, "", "b"), (None, "  ", "c"), (7, "Same Words here now", "d"),
            (7, "same words HERE now", "e"), (9, "x " * 50_000, "f")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string"), "doc_id", "text", 5, 4)
    assert sorted((r.key or -1, r.component) for r in got.collect()) == [(-1, 3), (3, 3), (5, 3), (7, 7), (7, 7), (9, 9)]
    assert simhash.near_duplicates(spark.createDataFrame([], "a long, t string"), "a", "t", 5, 4).count() == 0
    with pytest.raises(ValueError):
        simhash.fingerprint_links(spark.range(1), 6)


def brute_links(rows, threshold=0.95):
    good = [(k, np.array(v, float)) for k, v in rows
            if v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    x = np.array([v / np.linalg.norm(v) for _, v in good])
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    links = [(i, j) for i, j in zip(*np.nonzero(near))]
    keys = [k for k, _ in good]
    order = np.argsort(keys, kind="stable")
    place = np.argsort(order)
    top = roots(len(keys), [(int(place[i]), int(place[j])) for i, j in links])
    out = {k: (0, k) for k, _ in rows}
    out |= {keys[i]: (int(near[i].sum()), keys[order[top[place[i]]]]) for i in range(len(keys))}
    return out


@pytest.mark.parametrize("rows", [16, 4096])
def test_vector_links_match_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(rotation_codes, "CELL_ROWS", rows * 4)
    rng = np.random.default_rng(0)
    base = rng.standard_normal((150, 24))
    near = base[:80] + rng.standard_normal((80, 24)) * rng.uniform(0, 0.4, (80, 1))
    data = [(int(k), v.astype(np.float32).tolist()) for k, v in enumerate(np.r_[base, near, base[:20], base[:9] * 3])]
    data += [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24), (903, [None] * 24),
             (904, [float("inf")] + [1.0] * 23), (905, [1e30] * 24), (906, [1e-30] * 24)]
    short = [(910, [1.0, 2.0, 0.5]), (911, [1.0, 2.0, 0.5]), (912, [-1.0, 0.0, 3.0]), (913, [2.0, 4.0, 1.1]), (914, [7.0])]
    frame = spark.createDataFrame(data + short, "id long, v array<float>")
    got = {r.key: (r.n_links, r.component) for r in rotation_codes.linked(frame, "id", "v").collect()}
    assert got == brute_links(data) | brute_links(short[:4]) | {914: (0, 914)} and got[910] == (2, 910)


def test_vector_links_on_the_table(spark):
    data = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in queries.rotation_code_links(spark, FOLDER).collect()}
    assert got == brute_links(data)
    empty = spark.createDataFrame([(1, None)], "id long, v array<float>")
    assert [tuple(r) for r in rotation_codes.linked(empty, "id", "v").collect()] == [(1, 0, 1)]
    assert rotation_codes.linked(empty.filter("false"), "id", "v").count() == 0
    odd = spark.createDataFrame([(None, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0]), (4, [1.0, 0.01])], "id long, v array<float>")
    assert sorted((r.key or -1, r.n_links, r.component) for r in rotation_codes.linked(odd, "id", "v").collect()) == [
        (-1, 3, 3), (3, 3, 3), (3, 3, 3), (4, 0, 4), (4, 3, 3)]


def test_estimates_are_unbiased_and_bounded():
    rng, d, bias, misses = np.random.default_rng(3), 64, [], 0
    for seed in range(40):
        turn = rotation_codes.rotation(d, seed)
        o, q = (rotation_codes.unit(rng.standard_normal((200, d))) for _ in range(2))
        q = rotation_codes.unit(o + rng.uniform(0.1, 2) * q)
        codes, factor = rotation_codes.encode(o, turn)
        s = np.einsum("nd,nd->n", rotation_codes.corners(codes, d), q @ turn)
        true = (o * q).sum(axis=1)
        bias.append((s / factor - true).mean())
        close = true >= 0.95
        misses += (s[close] < rotation_codes.least_estimate(factor, 0.95, d, None)[close]).sum()
    assert abs(np.mean(bias)) < 0.01 and misses == 0


def brute_top(rows, asks, k):
    out = []
    for q in asks:
        others = sorted((-sum(a * b for a, b in zip(rows[q], v)), i) for i, v in rows.items() if i != q)
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(others[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("spread,shard", [(300, 64), (2, 50), (40, 4096)])
def test_top_k_matches_brute_force(spark, spread, shard):
    rng = np.random.default_rng(spread)
    base = rng.integers(-spread, spread + 1, (300, 16))
    base[150:250] = np.clip(base[:100] + rng.integers(-1, 2, (100, 16)), -spread, spread)
    rows = {i: v.tolist() for i, v in enumerate(base)}
    frame = spark.createDataFrame(list(rows.items()), "vec_id long, t array<long>")
    got = maxscore.top_k(frame, frame.filter("vec_id % 7 = 0"), "vec_id", "t", 5, shard, 20)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, range(0, 300, 7), 5)


def test_top_k_odd_rows(spark):
    rows = [(0, [1, 1]), (1, None), (2, [0, 0]), (3, [None, 1]), (4, [-1, -1]), (4, [-1, -1]), (None, [1, 1]), (6, [1]), (7, []), (8, [2])]
    frame = spark.createDataFrame(rows, "vec_id long, t array<long>")
    got = maxscore.top_k(frame, frame.filter("vec_id in (0, 1, 2, 6, 7)"), "vec_id", "t")
    assert sorted(map(tuple, got.collect())) == [(0, 1, 2, 0), (0, 2, 4, -2), (2, 1, 0, 0), (2, 2, 4, 0), (6, 1, 8, 2)]
    assert maxscore.top_k(frame.filter("false"), frame, "vec_id", "t").count() == 0


def test_top_k_repeated_rows(spark):
    rng = np.random.default_rng(4)
    rows = {i: v.tolist() for i, v in enumerate(rng.integers(-20, 21, (200, 8)))}
    rows[50] = [30] * 8
    want = brute_top(rows, range(0, 200, 10), 5)
    many = [*rows.items(), *[(50, rows[50])] * 5, *[(i, rows[i]) for i in range(0, 200, 3)]]
    shard = maxscore.Shard(np.array([i for i, _ in many]), np.array([v for _, v in many]), np.zeros(len(many)), 32)
    own = np.arange(0, 200, 10)
    found = shard.top(np.array([rows[i] for i in own]), own, np.full(len(own), maxscore.NONE), 5)
    assert [(q, n, i, x) for q, (ids, scores) in zip(own.tolist(), found)
            for n, (i, x) in enumerate(zip(ids.tolist(), scores.tolist()), 1)] == want
    frame = spark.createDataFrame(many, "vec_id long, t array<long>")
    got = maxscore.top_k(frame, frame.filter("vec_id % 10 = 0"), "vec_id", "t", 5)
    assert sorted(map(tuple, got.collect())) == want


def test_most_records_are_never_scored():
    """Under a third of records are scored in full, on clusters and without; blocks are skipped."""
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((40, 32))
    for clustered in (True, False):
        base = centres[rng.integers(0, 40, 4096)] + 0.2 * rng.standard_normal((4096, 32)) if clustered else rng.standard_normal((4096, 32))
        rows = np.floor(256 * base / np.linalg.norm(base, axis=1, keepdims=True)).astype(np.int64)
        near = ((rows[:, None, :] - np.round(centres * 45)) ** 2).sum(axis=2).argmin(axis=1)
        shard = maxscore.Shard(np.arange(4096), rows, near, 128)
        own, scores = np.arange(0, 4096, 50), rows @ rows.T
        sample = np.arange(0, 4096, 4)
        bars = np.array([np.sort(scores[q, sample[sample != q]])[-5] for q in own])
        found = shard.top(rows[own], own, bars, 5)
        for q, (ids, top) in zip(own, found):
            others = sorted((-scores[q, i], i) for i in range(4096) if i != q)[:5]
            assert list(zip((-top).tolist(), ids.tolist())) == others
        assert shard.scored < len(own) * 4096 / 20
        assert shard.skipped > len(own) * 4096 / 2 or not clustered


@pytest.mark.parametrize("limit", [40, 1 << 14])
def test_hot_anchors_are_cut(spark, limit):
    """Thousands of fingerprints at one anchor: cut in blocks, and no link is lost."""
    rng = np.random.default_rng(limit)
    base = int(rng.integers(0, 2 ** 62))
    fps = {base ^ sum(1 << int(b) for b in rng.choice(np.arange(21, 63), rng.integers(0, 12), replace=False)) for _ in range(700)}
    fps = sorted(fps | {f ^ 1 for f in list(fps)[:200]})
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    want = {fps[i]: fps[r] for i, r in enumerate(roots(len(fps), links)) if i != r}
    frame = spark.createDataFrame([(x,) for x in fps], "fp long")
    found = simhash.fingerprint_links(frame, 4, limit=limit)
    assert {r.node: r.root for r in common.components(found).collect()} == want


def test_one_of_each_group_stays(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(vocabulary, 300)) for _ in range(60)]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    for i in range(40):
        words = texts[i].split()
        words[int(rng.integers(0, 300))] = "changed"
        rows.append((100 + i, " ".join(words), "y"))
    rows += [(200, texts[3], "z"), (5, texts[5], "again"), (None, texts[7], "n"), (None, None, "n"), (201, "", "e"), (202, None, "e")]
    keyed = [(k, t) for k, t, _ in rows if k is not None]
    prints = [brute_print(t, 4) for _, t in keyed]
    order = sorted(range(len(keyed)), key=lambda i: keyed[i][0])
    links = [(a, b) for a in range(len(order)) for b in range(a)
             if (prints[order[a]] ^ prints[order[b]]).bit_count() <= 4]
    tops = roots(len(order), links)
    want = sorted({keyed[order[t]][0] for t in tops})
    frame = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    left = [r.doc_id for r in simhash.one_of_each(frame, "doc_id", "text", 4, 4).collect()]
    assert sorted(x for x in left if x is not None) == want and left.count(None) == 2
    assert 200 not in left and 202 not in left and 60 <= len(want) < len(keyed) - 5
    assert simhash.one_of_each(frame.filter("false"), "doc_id", "text", 4, 4).count() == 0


def test_the_cover_finds_all_close_pairs():
    rng = np.random.default_rng(9)
    cover = simhash.NARROW
    fps = rng.integers(-2 ** 63, 2 ** 63 - 1, 200)
    flips = [np.bitwise_xor.reduce(np.int64(1) << rng.choice(64, cover.most, replace=False).astype(np.int64)) for _ in fps]
    other = fps ^ np.array(flips)
    (i, a, home), (j, b, _) = simhash.at_anchors(fps, cover), simhash.at_anchors(other, cover)
    homes, near = set(zip(i[home].tolist(), a[home].tolist())), set(zip(j.tolist(), b.tolist()))
    assert {x for x, _ in homes & near} == set(range(200))
