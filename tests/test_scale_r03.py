"""Steps that must not grow faster than their input. Every test builds its own rows."""

from __future__ import annotations

from lodestone.operators import containment, usage


def test_runs_without_a_phrase_stay_in_the_scan(spark, monkeypatch):
    """of a text's runs of two words only such as a phrase can be in are written."""
    written = []

    def counted(df):
        kept = df.localCheckpoint()
        written.append(kept.count())
        return kept

    monkeypatch.setattr(containment, "cut_lineage", counted)
    text = " ".join(f"w{i}x" for i in range(2000)) + " blue anvil"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "lightblue  anvils")], "doc_id long, text string")
    phrases = spark.createDataFrame([("Blue Anvil",), ("e  a",)], "w string")
    found = containment.contains_any(docs, "doc_id", "text", phrases, "w").collect()
    assert {tuple(r) for r in found} == {(1, "Blue Anvil"), (3, "e  a")}
    assert max(written) < 50


def test_phrases_of_every_length(spark):
    """pieces of words, words, and several words, by brute force."""
    texts = [(1, "the other théâtre of  it"), (2, "a"), (3, ""), (4, None), (None, "it is and e e"), (1, "xx of the the of"), (5, " e ")]
    wanted = ["e", "th", "THE", "ther", "théâ", "é", "of the", "of  it", "e e", " ", "  ", "e ", " e", "it is and", "it is and e", "is and e e ", "", "qq"]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    phrases = spark.createDataFrame([(w,) for w in wanted] + [(None,), ("e",)], "w string")
    got = containment.contains_any(docs, "doc_id", "text", phrases, "w").collect()
    want = {(k, w) for k, t in texts if t for w in wanted if w and w.lower() in t.lower()}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_pieces_of_a_text_are_rows(spark):
    """different pieces of every size, each once, without a list made for each text."""
    texts = ["aaaaab", "théâtre", "ab", "a", "", "abcabcabc", "x y x y", "🙂🙂ab🙂🙂ab", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for sizes in ([4], [2, 4], [1, 2, 3, 4]):
        made = containment.spelled(df, "t", sizes)
        assert "lambda" not in made._jdf.queryExecution().optimizedPlan().toString()
        got = sorted(tuple(r) for r in made.collect())
        assert got == sorted({(t, t[i:i + n]) for t in texts if t for n in sizes for i in range(len(t) - n + 1)})


def test_names_of_files_are_counted_once(spark, monkeypatch):
    """the join of names with files takes the counts that the search was made on."""
    given = []
    joined = usage.skewed_join

    def seen(*args, **named):
        given.append(named.get("rows_of"))
        return joined(*args, **named)

    monkeypatch.setattr(usage, "skewed_join", seen)
    files = spark.createDataFrame([("r", "a.rs", "Use Serde_json;"), ("r", "a.rs", "tokio"), ("r", "b.rs", "x"), (None, "c.rs", "serde"),
                                   ("q", "d.rs", "serde")], "repo string, path string, content string")
    deps = spark.createDataFrame([("r", "s/serde", ["serde"]), ("r", "t/tokio", ["tokio", "kio"]), (None, "s/serde", ["serde"])],
                                 "repo string, dep string, terms array<string>")
    found = sorted(tuple(r) for r in usage.term_hits(files, deps).collect())
    assert found == [("r", "a.rs", "s/serde"), ("r", "a.rs", "t/tokio")]
    assert given and all(r is not None for r in given)
