"""Exact duplicates, hard negatives and token alignment beside brute force and SQL."""

from collections import Counter
from hashlib import sha256

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestone.llm import alignment, exact_dedup, multi_index, queries
from lodestone.operators import prefilter

FOLDER = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("name", ["op11_multi_index", "op12_exact_dedup"])
def test_sql_agrees(spark, name):
    run, sql = queries.QUERIES[name]
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    want = con.execute(sql).fetchall()
    columns = [x[0] for x in con.description]
    got = run(spark, FOLDER).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(want) and want


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_exact_duplicates_odd_rows(spark):
    long = "Long text " * 30_000
    rows = [(1, "Same", "x"), (9, "sAME", "y"), (9, "same", "z"), (None, "SAME", "n"), (2, None, "e"), (3, "", "e"),
            (4, "É", "u"), (5, "é", "u"), (6, long, "l"), (7, long.upper(), "l"), (8, long[:-1] + "x", "l"),
            (10, "K", "k"), (11, "K", "kelvin"), (None, "alone", "n")]
    rows += [(100 + i, "copy of a third", "h") for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _size string").withColumnRenamed("_size", "_key")
    got = exact_dedup.exact_duplicates(frame, "doc_id", "text", keep=["_key", "text"]).collect()
    groups = {}
    for k, t, _ in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(k)
    assert sorted((r.key or -1, r._key) for r in got) == sorted((k or -1, x) for k, _, x in rows)
    for r in got:
        own = groups[(r.text or "").translate(LOWER)]
        best = max((k for k in own if k is not None), default=None)
        assert (r.keep_key, r.group_size) == (best, len(own))
    assert Counter((r.text or "").translate(LOWER) for r in got if r.kept) == Counter(list(groups))
    assert all(r.key == r.keep_key for r in got if r.kept)
    assert exact_dedup.exact_duplicates(frame.filter("false"), "doc_id", "text").count() == 0


def test_only_suspects_are_hashed_whole(spark):
    """A slot is set for each shared (length, prefix), and for few others."""
    frame = spark.range(20_000).selectExpr("id as _size", "id * 7 as _head")
    found = prefilter.may_match(frame, frame.filter("_size % 10 = 0"), "_size", "_head").collect()
    assert all(r._may for r in found if r._size % 10 == 0)
    assert sum(r._may for r in found) < 2_000 + 18_000 * 0.08
    plan = exact_dedup.exact_duplicates(
        spark.read.parquet(f"{FOLDER}/documents.parquet"), "doc_id", "text")._jdf.queryExecution().toString()
    assert not any("text" in line for line in plan.splitlines() if "Exchange" in line)


def test_prefix_is_no_limit(spark):
    texts = ["a" * 200 + c for c in "xyzxX"]
    frame = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = exact_dedup.exact_duplicates(frame, "k", "t", prefix=8).collect()
    assert sorted((r.key, r.keep_key, r.group_size) for r in got) == [(0, 4, 3), (1, 1, 1), (2, 2, 1), (3, 4, 3), (4, 4, 3)]


def brute_negatives(rows, positives, negatives, low=30, high=90):
    out = []
    for a, (label, vec) in rows.items():
        if a % 10:
            continue
        met = sorted((-sum(x * y for x, y in zip(vec, v)), i, l) for i, (l, v) in rows.items() if i != a and len(v) == len(vec))
        good = [(i, -s) for s, i, l in met if l == label][:positives]
        for p, ps in good:
            bad = [(i, -s) for s, i, l in met if l != label and low * ps <= -100 * s <= high * ps][:negatives]
            out += [(a, p, rank, i, ps, s) for rank, (i, s) in enumerate(bad, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed,spread,shard", [(0, 0.2, 64), (1, 3.0, 50), (2, 0.0, 4096)])
def test_hard_negatives_match_brute_force(spark, monkeypatch, seed, spread, shard):
    monkeypatch.setattr(multi_index, "SAMPLE", 100)
    rng = np.random.default_rng(seed)
    centres = rng.integers(-60, 61, (8, 9))
    base = centres[rng.integers(0, 8, 500)] + np.round(rng.standard_normal((500, 9)) * 20 * spread).astype(int)
    rows = {i: (int(rng.integers(0, 3)), v.tolist()) for i, v in enumerate(base)}
    rows |= {1000 + i: (i % 2, [i - 5, 3]) for i in range(12)} | {2000 + i: (1, [7]) for i in range(3)}
    rows[1010] = (0, [2 ** 30, -2 ** 29])  # beyond exact doubles
    rows[1011] = (1, [2 ** 29, 2 ** 27 + 1])
    data = [(i, v, l) for i, (l, v) in rows.items()] + [(10, rows[10][1], rows[10][0])]
    data += [(3000, None, 1), (3010, [None] * 9, 1), (None, base[0].tolist(), 1), (3020, base[0].tolist(), None), (3030, [], 1)]
    frame = spark.createDataFrame(data, "id long, bar array<long>, cell int").repartition(3)
    got = multi_index.hard_negatives(frame, "id", "bar", "cell", F.col("id") % 10 == 0, 3, 4, shard_rows=shard, block_anchors=9)
    want = brute_negatives(rows, 3, 4)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 500
    assert multi_index.hard_negatives(frame.filter("false"), "id", "bar", "cell", F.lit(True)).count() == 0


def test_walk_falls_and_covers_all():
    rng = np.random.default_rng(5)
    first, second = rng.standard_normal(13), rng.standard_normal(7)
    first[4] = -np.inf
    steps = list(multi_index.walk(first, second))
    assert [b for b, *_ in steps] == sorted((b for b, *_ in steps), reverse=True)
    assert {(i, j) for _, i, j in steps} == {(i, j) for i in range(13) if i != 4 for j in range(7)}
    assert all(np.isclose(b, first[i] + second[j]) for b, i, j in steps)
    assert not list(multi_index.walk(first[4:5], second))


def test_walk_stops_early_on_clusters():
    """On clustered vectors the certified walk scores under a third of the rows."""
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((40, 16)) * 100
    rows = np.round(centres[rng.integers(0, 40, 4000)] + rng.standard_normal((4000, 16)) * 8).astype(np.int64)
    books = multi_index.fit_books(rows[:1000].astype(float))
    labels, ids = rng.integers(0, 5, 4000), np.arange(4000)
    index = multi_index.Index(books, ids, labels, rows, *books.cells(rows.astype(float)))
    for a in range(50):
        x = multi_index.Asked(multi_index.NONE, 2 ** 62, multi_index.NONE, True)
        index.search(rows[a], a, labels[a], [x], 5)
        scores = rows @ rows[a]
        same = np.flatnonzero((labels == labels[a]) & (ids != a))
        want = same[np.lexsort((same, -scores[same]))[:5]]
        assert x.ids.tolist() == want.tolist()
    assert index.probed < 50 * 4000 / 3


def test_parts_are_even():
    parts = multi_index.deal({5: 10, 2: 90, 9: 250, 11: 30, 12: 100}, 100)
    assert parts == {2: (0, 1), 5: (0, 1), 9: (1, 3), 11: (4, 1), 12: (5, 1)}


def plain_alignment(texts):
    """What the contract asks for, from whole texts and token bytes alone."""
    a, b = alignment.ByteLevel(A), alignment.Pieces(B)
    out, counts = [], Counter()
    for t in texts:
        s = " " + (t or "")
        ia = a.model.encode(s, add_special_tokens=False).ids if t else []
        ib = b.model.encode(t) if t else []
        if not t or b"".join(a.bytes[i] for i in ia) != s.encode() or b"".join(b.bytes[i] for i in ib) != s.encode():
            out.append(([], [], []))
            continue
        ends = []
        for ids, table in ((ia, a.bytes), (ib, b.bytes)):
            at, own = 0, {}
            for n, i in enumerate(ids):
                at += len(table[i])
                own[at] = n
            ends.append(own)
        groups, ga, gb = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            na, nb = ends[0][cut] + 1, ends[1][cut] + 1
            groups.append((ia[ga:na], ib[gb:nb]))
            ga, gb = na, nb
        counts.update((x[-1], y[-1]) for x, y in groups)
        out.append((ia, ib, groups))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    rows = []
    for ia, ib, groups in out:
        links = [(x[-1], y[-1]) for x, y in groups]
        line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((len(ia), len(ib), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links),
                     sum(counts[p] for p in links), sha256(line.encode()).hexdigest() if line else ""))
    return rows


HARD = [None, "", " ", "  ", "a ", " a  b   c ", "\n", "x\ty\r\n z", "héllo wörld", "日本語のテキスト 🎉🎉", "👩‍👩‍👧 family", "नमस्ते दुनिया",
        "▁ marks ▁▁ it", "<|endoftext|> and <s></s> <unk> <0x41>", "I'm you'll 's 'S", "٣٤٥ ½ ⅷ", "áë", "\x00\x01\x1c\x85   end",
        "𓀀𓂀 rare", "ﬁ ligature ＡＢ", "tab nbsp 　wide", "€ 5 – “quoted” …", "123456 7890", "x" * 300 + " " + "é" * 90 + " " * 40 + "end",
        "퟿ private", "ünïcödé" * 30, "word " * 2000]


def test_alignment_matches_plain(spark):
    docs = [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").select("text").collect()]
    texts = docs + HARD + HARD[:4]
    frame = spark.createDataFrame([(t, i, "x") for i, t in enumerate(texts)], "text string, _row long, _text string").repartition(3)
    narrow = alignment.align(frame, "text", A, B, keep=["_row"]).withColumnRenamed("_row", "doc_id")
    for hot in (1, 1 << 17):
        got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, sha256(r.groups.encode()).hexdigest() if r.groups else "")
               for r in alignment.weighed(narrow, hot).collect()}
        want = plain_alignment(texts)
        assert [i for i in range(len(texts)) if got[i] != want[i]] == [] and len(got) == len(texts)
    assert sum(w[0] > 0 for w in want) > len(texts) - 12


def test_alignment_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    want = {k: w for (k, _), w in zip(docs, plain_alignment([t for _, t in docs]))}
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)
           for r in queries.token_alignment(spark, FOLDER).collect()}
    assert got == want


def test_cuts_need_decoded_bytes():
    """Coarse spans alone are not enough: several tokens share a character."""
    a, b = alignment.ByteLevel(A), alignment.Pieces(B)
    for text in (" 🎉 𓀀", " 日本", " é́", " \U0001f9ff\U0001faf6"):
        for tokenizer in (a, b):
            ids, sizes, count = tokenizer.cut([text, " x", text])
            assert sizes.tolist() == tokenizer.sizes[ids].tolist() and sizes.sum() == 2 * len(text.encode()) + 2
            assert count[0] == count[2] and count.sum() == len(ids)
    spans = a.model.encode(" 𓀀", add_special_tokens=False).offsets
    assert len(set(spans)) < len(spans)


def test_alignment_odd_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, links string")
    assert alignment.weighed(alignment.align(empty, "text", A, B, keep=["doc_id"])).count() == 0
    nothing = spark.createDataFrame([(1, None), (1, ""), (None, "x y")], "doc_id long, text string")
    got = alignment.align(nothing, "text", A, B, keep=["doc_id", "text"]).orderBy("n_a", "text").collect()
    assert [(r.doc_id, r.n_a, list(r.cuts), r.groups == "") for r in got] == [(1, 0, [], True), (1, 0, [], True), (None, 2, [2, 4], False)]


def test_word_table_is_bounded(monkeypatch):
    monkeypatch.setattr(alignment, "MOST_WORDS", 50)
    both = alignment.Aligner(alignment.ByteLevel(A), alignment.Pieces(B))
    for i in range(8):
        texts = [" ".join(f"w{i}{j}x" for j in range(15 + 5 * (i % 3))), "日本", " z" * 70, "y" * 300, "", "a\n\n b\n  c"]
        x = both.texts(texts)
        assert x.n_a.tolist() == [len(both.a.model.encode(" " + t, add_special_tokens=False).ids) if t else 0 for t in texts]
        assert x.n_b.tolist() == [len(both.b.model.encode(t)) for t in texts]
        assert x.size.tolist() == [len(t.encode()) + 1 if t else 0 for t in texts] and len(both.place) <= 50
