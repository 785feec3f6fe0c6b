"""Learned operators on held-out rows and small cases, page extraction, and the pipeline."""

import html
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import crf, extraction, language, quality, queries, toxicity

FOLDER = "/root/testdata/sf0.01"
ODD = [(1, None, "a"), (2, "", "b"), (3, " 12 !! ", "c"), (4, "x" * 100_000, "d"), (5, "same text", "e"), (5, "same text", "e")]
ODD_SCHEMA = "doc_id long, text string, score string"


def test_marginals_match_enumeration():
    rng, n, k = np.random.default_rng(0), 4, 3
    e, w = rng.standard_normal((n + 1, k)), crf.Weights(np.zeros((1, k)), rng.standard_normal((k, k)), rng.standard_normal(k))
    got, pairs = crf.marginals(e, np.array([n, 1]), w, pairs=True)
    total, want, edges = 0.0, np.zeros((n, k)), np.zeros((k, k))
    for path in np.ndindex(*[k] * n):
        p = np.exp(w.start[path[0]] + sum(e[t, path[t]] for t in range(n))
                   + sum(w.transition[path[t - 1], path[t]] for t in range(1, n)))
        total += p
        for t in range(n):
            want[t, path[t]] += p
        for t in range(1, n):
            edges[path[t - 1], path[t]] += p
    assert np.allclose(got[:n], want / total) and np.allclose(pairs, edges / total)
    assert np.allclose(got[n], np.exp(e[n] + w.start) / np.exp(e[n] + w.start).sum())


def rows_of(spark, fn):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = fn(spark, FOLDER).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    return rows, docs, labels


def test_language_on_held_out(spark):
    rows, docs, _ = rows_of(spark, queries.crf_language)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) / len(held) > 0.95


def test_quality_on_held_out(spark):
    rows, _, labels = rows_of(spark, queries.crf_quality)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id].quality for r in held) / len(held) > 0.9


def test_toxicity_on_held_out(spark):
    rows, _, labels = rows_of(spark, queries.counterfactual_toxicity)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id].toxic for r in held) / len(held) > 0.9


def test_mixed_text_is_labelled_by_word(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = queries.language_model(docs)
    english, german = (docs.filter(f"lang = '{x}' and n_chars > 800").first().text[:300] for x in ("en", "de"))
    frame = spark.createDataFrame([(1, english + " " + german)], "doc_id long, text string")
    got = language.identify(frame, "text", model, with_runs=True).first()
    shares = {x: sum(r.words for r in got.lang_runs if r.lang == x) for x in ("en", "de")}
    assert min(shares.values()) > 0.3 * sum(r.words for r in got.lang_runs)
    assert sum(r.words for r in got.lang_runs) == len(language.LETTERS.findall(english + " " + german))


def test_swaps_take_weight_off_groups():
    rng = np.random.default_rng(2)
    filler = [f"word{i}" for i in range(60)]
    sample = []
    for i in range(400):
        toxic = i % 2
        words = list(rng.choice(filler, 8))
        if rng.random() < (0.8 if toxic else 0.1):
            words.append("muslims")
        if toxic:
            words.append(str(rng.choice(["vilest", "foulest"])))
        sample.append((toxic, " ".join(words)))
    plain, fair = toxicity.train(sample, swap=0.0), toxicity.train(sample, swap=20.0)
    gap = [abs(m.word_score("muslims") - m.word_score("christians")) for m in (plain, fair)]
    assert gap[0] > 0.05 and gap[1] < 0.1 * gap[0]
    neutral = [m.bias + m.word_score("muslims") for m in (plain, fair)]
    assert neutral[1] < neutral[0] + 0.05 and fair.bias + fair.word_score("vilest") > 0


def test_cuts_in_a_chain_change_nothing():
    rng, k = np.random.default_rng(3), 4
    w = crf.Weights(np.zeros((1, k)), rng.standard_normal((k, k)) * 2, rng.standard_normal(k))
    lengths = np.array([3, 900, 64, 65, 1, 500])
    e = rng.standard_normal((lengths.sum(), k)) * 2
    assert np.allclose(crf.long_marginals(e, lengths, w, 64), crf.marginals(e, lengths, w)[0])


def test_long_runs_are_read_whole(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = queries.language_model(docs)
    english, german = ("".join(re.findall("[a-z]", docs.filter(f"lang = '{x}' and n_chars > 3000").first().text)) for x in ("en", "de"))
    run = english[:32] + (german * 9)[:9000] + english[-32:]
    frame = spark.createDataFrame([(1, run)], "doc_id long, text string")
    assert language.identify(frame, "text", model).first().lang_pred == "de"


def brute_grams(word):
    """Hashes of a word's n-grams, one letter at a time."""
    codes, out = [ord(c) for c in f"^{word}$"], []
    for n in (2, 3, 4):
        for at in range(len(codes) - n + 1):
            if n == 4 and at not in (0, len(codes) - n):
                continue
            value = codes[at] * 0x9E3779B97F4A7C15 % 2 ** 64
            for c in codes[at + 1:at + n]:
                value = (value * 0x100000001B3 + c) % 2 ** 64
            out.append(((value ^ value >> 29) * 0xBF58476D1CE4E5B9 % 2 ** 64) >> 47)
    return sorted(out)


def test_word_features_match_plain_ones():
    words = ["a", "été", "straße", "x" * 100, "日本語", "ab"]
    flat, counts = language.grams(words)
    assert [sorted(x.tolist()) for x in np.split(flat, np.cumsum(counts)[:-1])] == [brute_grams(w) for w in words]


def brute_measures(line):
    """The twelve measures of a line, word by word."""
    words = line.split()
    if not words:
        return [0.0] * 12
    kind = [quality.kinds()[ord(c)] for c in line]
    letters = sum(k in (quality.LETTER, quality.UPPER) for k in kind)
    pairs, steps = list(zip(words, words[1:])), max(1, len(words) - 1)
    return [np.log1p(len(words)), sum(not any(c.isalpha() for c in w) for w in words) / len(words), letters / len(line),
            sum(k == quality.DIGIT for k in kind) / len(line), sum(k == quality.MARK for k in kind) / len(words),
            sum(k == quality.UPPER for k in kind) / max(1, letters),
            sum(len(w) > 1 and w[-1] == w[-2] and quality.kinds()[ord(w[-1])] == quality.MARK for w in words) / len(words),
            sum(a == b for a, b in pairs) / steps, len(set(words)) / len(words), 1 - len(set(pairs)) / steps,
            letters / len(words), float(words[-1][-1] in ".!?…")]


def test_line_measures_match_plain_ones(spark):
    lines = ["", "  ", "One two two, 33 THREE!!", "|| -- ||", "éa b éa b éa.", "x" * 500, "a", "End of it…  "]
    lines += [x for r in spark.read.parquet(f"{FOLDER}/documents.parquet").limit(40).collect() for x in r.text.split("\n")]
    lines = [x for x in lines if not set(x) & set("\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029")]
    assert np.allclose(quality.measures(lines), [brute_measures(x) for x in lines])


def test_many_different_words_are_scored():
    words = [f"{i:x}" for i in range(3_000_000)]
    lines = [" ".join(words[i:i + 2]) for i in range(0, len(words), 2)]
    got = quality.measures(lines)
    assert got.shape == (len(lines), 12) and np.allclose(got[:, 8], 1) and np.allclose(got[:, 9], 0)


def plain_toxicity(text, model):
    total = model.bias
    for word in set(re.findall(r"\w+", text.lower())):
        parts = ["=" + word] + ["^" + word[:n] for n in (3, 4, 5, 6) if len(word) > n] + ["$" + word[-4:]] * (len(word) > 4)
        total += sum(model.weights[model.numbers[p]] for p in parts if p in model.numbers)
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def plain_chain(scores, w):
    """Label probabilities by forward-backward in plain steps."""
    step = np.exp(w.transition)
    forward, back = [np.exp(scores[0] + w.start)], [np.ones(len(w.start))]
    for x in scores[1:]:
        forward.append((forward[-1] @ step) * np.exp(x))
        forward[-1] /= forward[-1].sum()
    for x in scores[:0:-1]:
        back.append(step @ (np.exp(x) * back[-1]))
        back[-1] /= back[-1].sum()
    both = np.array(forward) * np.array(back[::-1])
    return both / both.sum(axis=1, keepdims=True)


def test_language_scores_match_plain_ones(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = queries.language_model(docs)
    for r in language.identify(docs.limit(25).select("text"), "text", model).collect():
        words = re.findall(r"[^\W\d_]+", r.text.lower())
        scores = []
        for word in words:
            numbers = brute_grams(word)
            if word in model.known:
                numbers += [model.known[word]] + [n for n in [model.lexicon.get(word)] if n is not None]
            scores.append(model.weights.emission[numbers].astype(float).sum(axis=0))
        share = plain_chain(scores, model.weights).mean(axis=0)
        assert model.languages[int(share.argmax())] == r.lang_pred and abs(share.max() - r.score) < 1e-3


def test_quality_scores_match_plain_ones(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    model = queries.quality_model(docs, labels)
    for r in quality.score(docs.limit(25).select("text"), "text", model).collect():
        lines = r.text.split("\n")
        bins = [[int(np.searchsorted(model.edges[k], v, "right")) for k, v in enumerate(brute_measures(x))] for x in lines]
        beyond, scores = [quality.BINS] * 12, []
        for i, own in enumerate(bins):
            near = own + (bins[i - 1] if i else beyond) + (bins[i + 1] if i + 1 < len(bins) else beyond)
            scores.append(model.weights.emission[[j * (quality.BINS + 1) + b for j, b in enumerate(near)]].sum(axis=0))
        weight = np.array([len(x) + 1.0 for x in lines])
        share = (plain_chain(scores, model.weights)[:, 1] * weight).sum() / weight.sum()
        x = model.slope * np.log((share + 1e-3) / (1 - share + 1e-3)) + model.shift
        assert abs(1 / (1 + np.exp(-x)) - r.score) < 1e-6


def test_toxicity_scores_match_plain_ones(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    model = queries.toxicity_model(docs, labels)
    rows = docs.limit(60).select("doc_id", "text")
    for r in toxicity.score(rows, "text", model).collect():
        assert abs(r.score - plain_toxicity(r.text, model)) < 1e-6


@pytest.mark.parametrize("kind", ["language", "quality", "toxicity"])
def test_odd_texts(spark, kind):
    frame = spark.createDataFrame(ODD, ODD_SCHEMA)
    if kind == "language":
        model = language.train([("en", "the cat and the dog " * 5), ("de", "der Hund und die Katze " * 5)])
        got = language.identify(frame, "text", model).collect()
        assert [r.lang_pred for r in sorted(got, key=lambda r: r.doc_id)][:3] == ["und"] * 3
        assert {r.lang_pred for r in language.identify(frame, "text", language.train([])).collect()} == {"und"}
        assert language.identify(frame.filter("false"), "text", model).count() == 0
    else:
        module = quality if kind == "quality" else toxicity
        model = module.train([(1, "good line.\nmore of it."), (0, "| | |\n!! !!")] * 4)
        got = module.score(frame, "text", model).collect()
        assert module.score(frame.filter("false"), "text", model).count() == 0
        for only in ([], [(1, "a")]):
            assert module.score(frame, "text", module.train(only)).count() == len(ODD)
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 5}) == 1


def expected_text(page):
    inner = re.search(r"<article>(.*)</article>", page, re.S).group(1)
    blocks = re.split(r"</?(?:p|h1)>", inner)
    plain = (" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "<br>" in b else "", b)).split()) for b in blocks)
    return "\n".join(b for b in plain if b)


def test_pages_match_their_articles(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    for r in queries.tree_extraction(spark, FOLDER).collect():
        assert r.text == expected_text(pages[r.page_id]) and r.n_chars == len(r.text)


LONG = "Sentence one, with commas, goes on for a while, and then a bit more to be long enough. "


@pytest.mark.parametrize("page,blocks", [
    (None, []), ("", []), ("plain", ["plain"]), ("a < b &amp; c&nbsp;d", ["a < b & c d"]),
    (f"<body><div class='side-bar'><p>{LONG}</p></div><div id=content><p>{LONG}<p>Short.<div>Tail</div></div>"
     f"<div class=comments><p>{LONG * 3}</p></div></body>", [LONG.strip(), "Short.", "Tail"]),
    (f"<main><header><h1>T</h1></header><p>{LONG}</p><form>q</form><aside>{LONG}</aside><ul><li>x<li>y</ul></main>",
     ["T", LONG.strip(), "x", "y"]),
    (f"<article><p>{LONG}</p><div hidden>{LONG}</div><p>a<script>if (a</p>b) x</script>b<!-- <p> -->c</p></article>",
     [LONG.strip(), "abc"]),
    (f"<div><p>{LONG}</p></div><script>never closed {LONG}", [LONG.strip()]),
    (f"<table><tr><td>{LONG}<td>two<tr><td>three</table>", [LONG.strip(), "two", "three"]),
])
def test_page_cases(page, blocks):
    assert extraction.main_blocks(page or "") == blocks


def test_deep_and_long_pages_are_read():
    deep = "<div>" * 3000 + LONG + "</div>" * 3000
    assert extraction.main_blocks(deep) == [LONG.strip()]
    assert len(extraction.main_blocks("<article>" + f"<p>{LONG}" * 5000)) == 5000


@pytest.mark.parametrize("page", [
    "<a " * 20_000, "<p title='x" * 20_000, '<a href="x>' * 20_000, "</script" * 20_000, "<script>" + "</script " * 20_000,
    "<!--" * 20_000, "<div>" * 20_000 + "".join(f"text {i}, and more<br></section>" for i in range(20_000)),
    "<div>a" * 20_000, "<span>" * 20_000 + "<p>x</p>y" * 20_000, "<p><table>" + "<span>" * 20_000 + "<div>x</div>" * 20_000,
    "<ul>" + "<li><i>" * 20_000, "&#x" * 30_000, "<a b=" * 20_000 + ">", "<" * 60_000, "class=" * 30_000 + ">"])
def test_broken_and_deep_pages_take_linear_time(page):
    start = time.process_time()
    extraction.main_blocks(page)
    assert time.process_time() - start < 2


@pytest.mark.parametrize("attrs", [
    "class='post-navigation'", "class='article-share'", "class='entry-tags'", "class=main-menu", "id=contentFooter", "hidden",
    "class='widget text-widget'", "aria-hidden=true", "style='display: none'", "role=navigation"])
def test_parts_beside_the_text_go(attrs):
    page = f"<body><div class=post-content><p>{LONG}</p><div {attrs}><p>{LONG * 2}</p></div><p>{LONG}</p></div></body>"
    assert extraction.main_blocks(page) == [LONG.strip()] * 2


def test_titles_stay_and_hidden_pages_go():
    page = f"<body><article><div class=entry-header><h1>T</h1></div><p title=it's>{LONG}</p></article><main hidden>{LONG * 9}</main></body>"
    assert extraction.main_blocks(page) == ["T", LONG.strip()]


def test_extraction_odd_rows(spark):
    frame = spark.createDataFrame([(1, None, "own"), (2, "", None), (None, "<p>x</p>", "t")], "page_id long, html string, text string")
    got = {r.page_id: r.text for r in extraction.extract(frame, "html", ["page_id"]).collect()}
    assert got == {1: "", 2: "", None: "x"}
    assert extraction.extract(frame.filter("false"), "html", ["page_id"]).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, FOLDER)
        rows = kept.collect()
        assert kept.columns == docs.columns and all(before[r.doc_id] == r for r in rows)
        if name == "simhash_near_dedup":
            assert len({r.text for r in rows}) == len(rows) == len({r.doc_id for r in rows})
            unique = {r.doc_id for r in rows}
        if name == "mixing":
            assert {r.doc_id for r in rows} == unique
        kept = spark.createDataFrame(rows, docs.schema)
    assert 0.75 * len(before) < len(unique) < len(before)
    packed = corpus_pipeline.pack(spark, kept, FOLDER)
    assert packed.filter("start = 0").count() == kept.count()
    assert packed.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").count() == 0


def test_pipeline_odd_rows(spark):
    """Nulls in any column, repeated rows, clashing names and empty tables, at every stage."""
    plain = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(150)
    odd = [(None, None, None, None, None), (-1, None, "en", "a", 0), (-2, "", None, None, None), (-3, "12 !!", "xx", "a", 5),
           (-4, "the same words as before and after " * 3000, "en", None, None), (-4, "the same words as before and after " * 3000, "en", None, None)]
    docs = plain.union(spark.createDataFrame(odd, plain.schema))
    extra = ["score", "lang_pred", "weight", "epoch", "_simhash_key", "block", "tokens", "_text", "key"]
    docs = docs.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in extra])
    kept = spark.createDataFrame(docs.collect(), docs.schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, FOLDER)
        rows = out.collect()
        assert out.columns == docs.columns and 0 < len(rows) and stage(spark, kept.limit(0), FOLDER).count() == 0
        assert all(r.score is None if r.doc_id is None else r.score == f"score{r.doc_id}" for r in rows)
        kept = spark.createDataFrame(rows, docs.schema)
        if name == "language_id":
            assert not {-1, -2, -3, None} & {r.doc_id for r in rows} and sum(r.doc_id == -4 for r in rows) == 2
            kept = kept.union(spark.createDataFrame(odd[:4], plain.schema).select("*", *[F.lit(None).cast("string").alias(c) for c in extra]))
            kept = kept.withColumn("score", F.when(F.col("doc_id").isNotNull(), F.concat(F.lit("score"), F.col("doc_id").cast("string"))))
        if name == "simhash_near_dedup":
            assert sum(r.doc_id == -4 for r in rows) == 1 and sum(r.doc_id == -2 for r in rows) == 1 and not any(r.doc_id == -1 for r in rows)
    packed = corpus_pipeline.pack(spark, kept, FOLDER)
    assert packed.filter("start = 0").count() == kept.count() and corpus_pipeline.pack(spark, kept.limit(0), FOLDER).count() == 0
