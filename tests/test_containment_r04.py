"""any number of phrases in texts, by masks of the phrases that words hold. Every test builds its own rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import containment, prefilter


@pytest.mark.parametrize("hot, length, copies", [(1 << 17, 64, 16), (1, 64, 1), (8, 64, 3), (1 << 17, 3, 2)])
def test_phrases_in_words_frequent_or_not(spark, monkeypatch, hot, length, copies):
    """Words that are broadcast, such as are not, and both; phrases that fill several buckets of masks."""
    for name, value in (("HOT_WORDS", hot), ("HOT_LENGTH", length), ("COPIES", copies)):
        monkeypatch.setattr(containment, name, value)
    rng = random.Random(3)
    syllables = ["ab", "c", "theo", "ry", "Ün", "x.", "é", "longest"]
    texts = [(i, " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(0, 5))) for _ in range(rng.randrange(0, 12))))
             for i in range(60)] + [(None, "ab theory"), (None, "c"), (7, "Ünx.  ab"), (90, None), (91, "ab " * 50)]
    words = sorted({w for _, t in texts if t for w in t.split(" ")} | {a + b for a in syllables for b in syllables} | set(syllables))
    phrases = words + [w.upper() for w in words[::5]] + ["b c", "ry  ab", " ", "y ab c", "", "none of", "ab ab ab ab"]
    phrases += [f"not in any {i}" for i in range(300)] + [f"none{i}" for i in range(300)]
    got = containment.contains_any(spark.createDataFrame(texts, "id int, t string"), "id", "t",
                                   spark.createDataFrame([(p,) for p in phrases], "p string"), "p").collect()
    want = {(k, p) for k, t in texts if t for p in phrases if p and p.lower() in t.lower()}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_texts_are_read_twice_whatever_phrases_there_are(spark, monkeypatch):
    """Once for words, once for runs of any number of words."""
    plans, write = [], containment.cut_lineage

    def noted(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df)

    monkeypatch.setattr(containment, "cut_lineage", noted)
    docs = spark.createDataFrame([(1, "it is the end of it"), (2, "no e")], "doc_id long, text string")
    phrases = spark.createDataFrame([(p,) for p in ("e", "en", "ende", "is t", "t is the", "the end of it", "o e")], "w string")
    got = containment.contains_any(docs, "doc_id", "text", phrases, "w").collect()
    assert {tuple(r) for r in got} == {(1, "e"), (1, "en"), (1, "is t"), (1, "t is the"), (1, "the end of it"), (2, "e"), (2, "o e")}
    reading = [p for p in plans if "lower(text" in p]
    assert len(reading) == 2  # short phrases, long ones, and each number of words before


def test_words_that_hold_a_phrase_are_one_row_of_a_key(spark, monkeypatch):
    """A phrase that all words of a text hold is put together ahead of the exchange."""
    monkeypatch.setattr(containment, "HOT_WORDS", 1 << 30)
    docs = spark.createDataFrame([(k, " ".join(f"e{i}" for i in range(400))) for k in range(5)], "k long, t string").coalesce(1)
    asked = containment.numbered(spark.createDataFrame([("e",), ("1",), ("e1",)], "w string"), "w")
    found = containment.in_words(docs, "k", "t", asked)
    assert containment.together(found, "_key").count() == 5
    assert containment.contains_any(docs, "k", "t", asked.select("_phrase"), "_phrase").count() == 15


def test_every_bit_of_a_bitmap_is_read_back(spark):
    keys = spark.range(40_000).filter("id % 3 = 0")
    for bits in (prefilter.PAGE, 4 * prefilter.PAGE):
        rows = spark.range(40_000).withColumn("_slot", prefilter.slot(bits, "id"))
        told = prefilter.with_pages(rows, prefilter.bitmap(keys, bits, "id"), bits, "id").withColumn("_set", prefilter.is_set(bits, "id"))
        taken = rows.filter("id % 3 = 0").select("_slot").distinct().withColumn("_want", F.lit(True))
        both = told.join(taken, "_slot", "left").filter(F.col("_set") != F.coalesce("_want", F.lit(False)))
        assert told.count() == 40_000 and both.count() == 0
