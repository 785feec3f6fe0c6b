"""Memory of the stages that send texts to Python: batches, pieces, and sums over features."""

import tracemalloc

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestone.llm import common, crf, language, packing, simhash, toxicity

SENDERS = {
    "language": lambda d: language.identify(d, "text", language.Model([])),
    "toxicity": lambda d: toxicity.score(d, "text", toxicity.Model()),
    "simhash": lambda d: simhash.fingerprints(d, "id", "text", 4),
    "packing": lambda d: packing.tokenise(d, "text", public_tokenizers.path("byte_bpe_50k.json"), ["id"]),
}


def texts(session, rows):
    return session.range(rows, numPartitions=1).select("id", F.repeat(F.lit("word "), 1000).alias("text"))


def batches(docs):
    """(rows, bytes) of each batch that a worker is sent."""
    def sizes(got):
        for b in got:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]})

    return [(r.rows, r.bytes) for r in docs.mapInArrow(sizes, "rows long, bytes long").collect()]


@pytest.mark.parametrize("sender", SENDERS)
def test_texts_go_to_python_in_small_batches(spark, sender):
    docs = texts(spark.newSession(), 2000)
    SENDERS[sender](docs)
    found = batches(docs)
    assert sum(n for n, _ in found) == 2000
    assert max(b for _, b in found) < 1.1 * common.BATCH_BYTES  # 10 MB in one batch before


def test_a_session_keeps_its_own_batch_size(spark):
    session = spark.newSession()
    session.conf.set(common.BATCH_SETTING, "64k")
    found = batches(common.small_batches(texts(session, 100)))
    assert sum(n for n, _ in found) == 100 and max(b for _, b in found) < 80_000


def test_texts_are_tagged_a_small_piece_at_a_time():
    column = pa.array(["x" * 100_000, None, ""] * 20 + ["y" * 1_000_000])
    pieces = list(common.chunks_of(column))
    assert [t for _, ts in pieces for t in ts] == [t or "" for t in column.to_pylist()]
    assert max(sum(map(len, ts)) for _, ts in pieces if len(ts) > 1) <= 1 << 19


def test_sums_over_features_are_bounded():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 40, 60_000)
    values, flat = rng.standard_normal((1000, 4)), rng.integers(0, 1000, counts.sum())
    tracemalloc.start()
    got = crf.ragged_sum(values, flat, counts)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    ends = np.cumsum(counts)
    for i in (0, 1, crf.RUNS - 1, crf.RUNS, 3 * crf.RUNS + 5, len(counts) - 1):
        assert np.allclose(got[i], values[flat[ends[i] - counts[i]:ends[i]]].sum(axis=0))
    assert not got[counts == 0].any()
    assert most < 12e6  # 37 MB of values at once before
    assert crf.ragged_sum(values, flat[:0], np.zeros(3, int)).tolist() == [[0.0] * 4] * 3


def test_fitting_holds_few_copies_of_its_positions():
    rng = np.random.default_rng(1)
    n, labels = 200_000, 4
    item, label = rng.integers(0, 500, n), rng.integers(0, labels, n)
    flat, counts = rng.integers(0, 100, 1000), np.full(500, 2)
    tracemalloc.start()
    crf.fit(flat, counts, item, np.full(n // 500, 500), label, 100, labels, rounds=2)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 5.5 * n * labels * 8  # copies of one number a position and label; 7.6 before
