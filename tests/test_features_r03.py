"""Steps of the features that tuning starts from. Every test builds its own rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import fixed, text
from lodestone.operators import graph

RULES = [("one", 0.1, ["forked", ""], ["Rust"]), ("two", 0.2, ["fork", "é a"], []), ("none", 0.4, [], []),
         ("three", 0.3, ["c++", "zk-"], ["Go", "Rust"]), ("four", 0.5, ["fork me"], [])]


def test_few_phrases_rule_by_rule(spark):
    """F8 to F12: phrases are looked for up to the first rule that holds, with the same outcome."""
    said = ["a FORK", "forked", "c++", "ZK-x", "É A", "", None, "fo rk", "zk_ c+", "  fork me "]
    df = spark.createDataFrame([(n, t, w, i) for n in ("n", "named", None) for t in said for w in ("c++", None)
                                for i in ("Rust", "Go", "C", None)], "n string, t string, w string, l string")
    kind = text.classify(F.col("n"), F.col("t"), F.col("w"), F.col("l"), RULES, {"kept": ["named"]})
    got = df.withColumn("k", kind)
    assert "filter(" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
    for r in got.collect():
        body = ((r.t or "") + " " + (r.w or "")).lower()
        want = next(((c, b) for c, b, phrases, languages in RULES if any(p and p in body for p in phrases)
                     and (not languages or r.l in languages)), (fixed.DEFAULT_CATEGORY, 0.0))
        assert tuple(r.k) == (("kept", 0.0) if r.n == "named" else want)


def test_first_pass_is_written_once(spark, monkeypatch):
    """F8 to F12: the first pass's node table is read from storage too."""
    written = []

    def counted(df):
        written.append(sorted(df.columns))
        return df.localCheckpoint()

    monkeypatch.setattr(graph, "cut_lineage", counted)
    edges = spark.createDataFrame([(1, 2), (1, 2), (3, 2), (2, 3), (9, 1), (None, 2)], "src int, dst int")
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    got = {r.id: r.producer_score for r in graph.producer_score(edges, nodes).collect()}
    assert got == {1: 0.0, 2: 0.7598, 3: 1.0}
    assert written == [["dst", "n", "src"], ["dst", "w"], ["dst", "w"]]
