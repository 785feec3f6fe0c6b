"""Sharding, packing and mixing: brute force and small cases."""

import math
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import mixing, packing, queries, sharding

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, tokens string"
ODD = [(1, None, None, None, None, "x", "y"), (2, "", "en", "", 0, None, None),
       (None, "no key", "en", "a", 6, None, None), (4, "tie tie", "en", "a", 7, "s", "t"),
       (4, "tie tie", "en", "a", 7, "s", "t"), (5, "long " * 30_000, "fr", "b", 150_000, None, None),
       (6, "<|endoftext|> inside \x1c é\n\n  x", "fr", "b", 1, None, None)]


def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def best_shard(key, weights):
    def bits(shard):
        seed = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
        return xxhash.xxh64_intdigest(struct.pack("<i", shard), seed) >> 11

    return min((-math.log((bits(s) + 0.5) * 2.0 ** -53) / w, s) for s, w in weights.items())[1]


def test_shards_match_brute_force(spark):
    rows = queries.rendezvous_sharding(spark, SMALL).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    eight = {s: 1.0 for s in range(8)}
    slots = defaultdict(list)
    for r in rows:
        blob = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(blob) + 1, zlib.crc32(blob), "key")
        assert r.shard == best_shard(r.doc_id, eight)
        assert r.grown_shard == best_shard(r.doc_id, eight | {8: 1.0})
        assert r.grown_shard in (r.shard, 8)
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_weights_set_shares_and_bad_weights_fail(spark):
    keys = spark.range(20_000)
    n = Counter(r.shard for r in sharding.shard_records(keys, "id", {0: 1.0, 1: 3.0}).collect())
    assert abs(n[1] / 20_000 - 0.75) < 0.02
    for bad in ({}, {0: 0.0}):
        with pytest.raises(ValueError):
            sharding.rendezvous(F.col("id"), bad)


def test_sharding_odd_rows(spark):
    out = sharding.with_slots(sharding.shard_records(odd(spark), "doc_id", {0: 1.0, 1: 1.0}), "shard")
    rows = out.collect()
    assert len(rows) == len(ODD) and len({r.shard for r in rows if r.doc_id == 4}) == 1
    assert out.filter("false").count() == 0
    empty = sharding.shard_records(odd(spark).filter("false"), "doc_id", {0: 1.0})
    assert sharding.with_slots(empty, "shard").count() == 0


def check_packing(rows, texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for key, text in texts.items():
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for p in sorted(pieces[key], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert zlib.crc32(ids[at:at + p.length].tobytes()) == p.ids_crc32
            at += p.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    return sum(r.length for r in rows) / (2048 * len(sequences))


def test_packing_covers_every_id(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert check_packing(queries.vector_packing(spark, SMALL).collect(), docs) > 0.97


def test_packing_odd_texts(spark):
    frame = odd(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    texts = {r.doc_id: r.text for r in frame.collect()}
    check_packing(queries.packed_documents(frame).collect(), texts)
    assert queries.packed_documents(odd(spark)).filter("start = 0").count() == len(ODD)
    assert queries.packed_documents(odd(spark).filter("false")).count() == 0


def test_encoder_matches_tokenizers_on_hard_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, encode = Tokenizer.from_file(path), packing.encoder(path)
    for text in ("", " ", "a  b c", "\x1cx\x85y", "it's I'LL 12³½", "日本語 🙂‍", "\n" * 5000,
                 " " * 200_000 + "x", "ab" * 40_000, "<|endoftext|><|endoftext", "\r\n\t x"):
        assert encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(3))
def test_place_keeps_every_limit(seed):
    rng = np.random.default_rng(seed)
    tokens = rng.integers(1, 1500, 400)
    demand = np.stack([tokens, np.ones(400, int), rng.integers(0, tokens + 1)], 1)
    limits = np.array([2048, 4, 900]) if seed else np.array([2048, 64, 2048])
    demand[:, 2] = np.minimum(demand[:, 2], limits[2])
    sequence, turn = packing.place(demand, limits)
    for s in range(sequence.max() + 1):
        own = demand[sequence == s]
        assert len(own) and (own.sum(axis=0) <= limits).all()
        assert sorted(turn[sequence == s]) == list(range(len(own)))
    least = np.ceil((demand.sum(axis=0) / limits).max())
    assert sequence.max() + 1 <= 1.1 * least + 1
    with pytest.raises(ValueError):
        packing.place(np.array([[3000, 1, 0]]), limits)


def test_packing_instruction_examples(spark):
    rows = [(i, 100 + i % 700, 50 + i % 90, "kept") for i in range(500)] + [(None, None, None, None)]
    frame = spark.createDataFrame(rows, "id long, tokens long, loss long, offset string").withColumn("one", F.lit(1))
    out = packing.pack(frame, {"tokens": 1024, "one": 3, "loss": 200}, "tokens", ["id"], group_rows=100)
    by = out.groupBy("sequence_id").agg(F.sum("tokens").alias("t"), F.sum("one").alias("o"), F.sum("loss").alias("l"))
    assert out.count() == 501 and by.filter("t > 1024 or o > 3 or l > 200").count() == 0


def brute_mix(rows, limit):
    """rows: key, source, tokens. Tokens of each source that the mixture shows."""
    total = Counter()
    for _, s, t in rows:
        total[s] += t
    lo, hi, shares = 0.0, 1.0, {s: t / sum(total.values()) for s, t in total.items()}
    for _ in range(40):
        mid = (lo + hi) / 2
        ok = min(shares.values()) ** (mid - 1) * max(shares.values()) ** (1 - mid) <= limit
        lo, hi = (lo, mid) if ok else (mid, hi)
    w = {s: p ** hi for s, p in shares.items()}
    return {s: w[s] * max(total[r] / w[r] for r in w) for s in w}, total


def test_mixture_meets_weights(spark):
    rows = [(i, "big" if i % 3 else f"s{i % 5}", 10 + i % 7) for i in range(3000)]
    docs = spark.createDataFrame([(i, s, "w " * (n - 1)) for i, s, n in rows], "id long, source string, text string")
    got = mixing.mix(docs, "id", "source", "text", max_repeat=2.0).collect()
    want, total = brute_mix(rows, 2.0)
    seen, copies = Counter(), Counter()
    for r in got:
        seen[r.source] += r.tokens
        copies[r.id, r.epoch] += 1
    assert {r.id for r in got} == set(range(3000)) and max(copies.values()) == 1
    for s in want:
        assert -1 <= seen[s] - want[s] <= 17
        assert seen[s] / total[s] < 2.01


def test_exponent_targets(spark):
    shares = spark.createDataFrame([("a", 0.7), ("b", 0.2), ("c", 0.1)], "source string, share double")
    e = mixing.bisect_exponent(shares, entropy=1.0)
    w = np.array([0.7, 0.2, 0.1]) ** e
    w /= w.sum()
    assert abs(-(w * np.log(w)).sum() - 1.0) < 1e-6
    e = mixing.bisect_exponent(shares, max_repeat=1.5, budget=1.0)
    w = np.array([0.7, 0.2, 0.1]) ** e
    assert abs((w / w.sum() / [0.7, 0.2, 0.1]).max() - 1.5) < 1e-6
    assert mixing.bisect_exponent(shares.filter("false"), max_repeat=2.0) == 1.0
    with pytest.raises(ValueError):
        mixing.bisect_exponent(shares)


def test_budget_smaller_than_the_corpus(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], "w " * 9) for i in range(400)], "id long, source string, text string")
    got = mixing.mix(docs, "id", "source", "text", max_repeat=None, entropy=math.log(2) - 1e-9, budget=0.5)
    assert {r.source: r.n for r in got.groupBy("source").agg(F.count("*").alias("n")).collect()} == {"a": 100, "b": 100}


def test_mixing_odd_rows(spark):
    got = mixing.mix(odd(spark), "doc_id", "source", "text").collect()
    first = [r for r in got if r.epoch == 0]
    assert len(first) == len(ODD) and {r.tokens for r in first if r.text is None} == {1}
    assert mixing.mix(odd(spark).filter("false"), "doc_id", "source", "text").count() == 0
