"""Token index, containment, bitmaps, upsert, sketches, wide rows and readers beside brute force."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import fixed, text
from lodestone.operators import aggregates, containment, joins, lexers, prefilter, project_row, usage
from lodestone.session import cut_lineage, drop_stages, fresh_path, shared_folder, stage_root
from lodestone.sources import readers
from lodestone.streaming import resume


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# ---- usage by the token index ------------------------------------------------------------

SNIPPETS = {
    "rust": ["use T::x;\n", "use T {a}\n", "use  T\n::b;", "extern crate T;", "extern\ncrate T-x", "T::go(1) ", "myT::go ", "T::a::T::b ",
             "#[derive(T, B)]", "#[derive(A,\n T::X)]", "#[T]", "#[T_x]", "#[derive(T", "#[derive(A) T]", "reuse T;", "use\tT;use T;"],
    "go": ['import "a/T/v2"\n', 'import  "T"', 'al "x/T"\n', '"T""T"\n', '"T" "T" "T"\n', '\n"xTy"  \n', "T.Do (1) ", "P.New(", "P.x ", 'say "hi', '" T "\n',
           "xT.Do(", "a.P.b("],
    "python": ["\nimport T\n", "\nimport T as al\n", "\nimport T.sub\n", "\nfrom T import x\n", "\nfrom T import x as bl\n", "\nfrom T. import y as cl ",
               "T.call(1) ", "T.x [", "al.run(2) ", "al.al.al.z ", "bl.q ", " import T", "\nimport\nT\n", "\nfrom T.sub import z as dl\ndl.k "],
    "javascript": ["import * as al from 'T';", 'const bl = require("T/sub");', "import cl from '@x/T'\n", "import type from 'T'\n", "from 'T' ",
                   "require( 'x/T' )", "require('T", "P.go(1)", "al.x.al.y ", "cl.z ", "let dl=require('T')\ndl.w ", "import * as T from 'T/x"],
    "java": ["\nimport org.T;\n", "\nimport T.x\n", "\nimport T-y\n", "T.go ", "T(1) ", "xT.go ", "T .x ", "T.T.T(", "\nimport static T"],
    "csharp": ["\nusing A.T;\n", "\nusing T", "T.Go(", "T.Go [", "T.Go ", "T.T.T ("],
    "ruby": ["require 'lib/T'\n", 'require "T', "T.go ", "T::X ", "T:x ", "require 'Tx'"],
    "nim": ["\nimport std/T\n", "\nimport T\n", "T.go ", "T.T.x "],
    "cpp": ['"lib/T.h"', "'T'T'T'", "`T`", '"T x"', "T.go ", "T::x ", "'a'T'", '""T"" '],
}
TERMS = ["lib", "a-b", "x/y", "np", "Lib", "a.b", "@s/p-q", "use"]
EXTENSION = {"rust": "rs", "go": "go", "python": "py", "javascript": "ts", "java": "java", "csharp": "cs", "ruby": "rb", "nim": "nim", "cpp": "cpp"}


@pytest.mark.parametrize("seed", [0, 1])
def test_token_index_counts_like_patterns_on_texts(spark, seed):
    """Pieces cut without any term give the counts of every pattern on whole texts."""
    rng = random.Random(seed)
    files = []
    for language, parts in SNIPPETS.items():
        for i in range(50):
            some = [rng.choice(parts).replace("T", rng.choice(TERMS)).replace("P", rng.choice(["y", "ab", "pq", "lib"])) for _ in range(rng.randrange(1, 14))]
            glue = rng.choice(["", " ", "\n", "é "])
            files.append((f"r{i % 2}", f"src/{language}{i}.{EXTENSION[language]}", glue.join(some)))
    deps = [(r, f"d{k}", ts) for r in ("r0", "r1") for k, ts in enumerate(
        [["lib"], ["a-b", "lib"], ["x/y", "z"], ["np"], ["Lib"], ["a.b"], ["@s/p-q"], ["lib", "lib"], ["absent"]])]
    f = spark.createDataFrame(files, "repo string, path string, content string")
    d = spark.createDataFrame(deps, "repo string, dep string, terms array<string>")
    got = {(r.repo, r.path, r.dep): (r.imports, r.aliases, r.calls) for r in usage.usage_per_file(f, d).collect()}
    language = F.coalesce(*[F.when(F.endswith("path", F.lit("." + e)), "typescript" if e == "ts" else n) for n, e in EXTENSION.items()])
    pairs = f.join(d, "repo").withColumn("language", language)
    gate = usage.may_occur(F.lower("content"), F.col("terms"), F.col("language"))
    plain = pairs.filter(gate).select("repo", "path", "dep", "content", usage.usage_in_text(
        F.col("content"), F.col("terms"), F.col("language")).alias("u")).collect()
    want = {(r.repo, r.path, r.dep): tuple(r.u) for r in plain if any(r.u)}
    wrong = {k: (got.get(k), want.get(k), next(c for p, q, c in files if q == k[1])) for k in got.keys() | want.keys() if got.get(k) != want.get(k)}
    assert not wrong, list(wrong.items())[:3]
    assert len(want) > 300


def test_candidates_match_the_test_on_texts(spark):
    files = [("r", "a.rs", "x LIB-core y"), ("r", "b.rs", "li b"), ("r", "c.py", "nothing"), ("r", "d.go", " \n "), ("s", "a.rs", "lib"), ("r", "vendor/a.rs", "lib")]
    deps = [("r", "d1", ["lib"]), ("r", "d2", ["other", "b-core"]), ("s", "d1", ["zzz"])]
    f = spark.createDataFrame(files, "repo string, path string, content string")
    d = spark.createDataFrame(deps, "repo string, dep string, terms array<string>")
    got = rows(usage.candidates(f, d).select("repo", "path", "dep"))
    assert got == [("r", "a.rs", "d1"), ("r", "a.rs", "d2"), ("r", "c.py", "d1"), ("r", "c.py", "d2")]


def test_lexers_take_linear_time(spark):
    import time

    long = ['"' * 30_000, "'" * 30_000, "a" * 100_000, "a." * 50_000, "#[derive(" * 10_000, "import " * 15_000, "use\n" * 15_000, " " * 100_000 + "x"]
    f = spark.createDataFrame([("r", f"a{i}.{e}", t) for i, t in enumerate(long) for e in ("rs", "go", "py", "js", "cpp")],
                              "repo string, path string, content string").repartition(8)
    start = time.time()
    lexers.token_index(usage.source_files(f), usage.FAMILIES).agg(F.sum("n")).collect()
    assert time.time() - start < 60


def exchanged(df):
    """Lines of the final plan that shuffle or broadcast."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange" in line]


def test_no_text_crosses_an_exchange(spark, monkeypatch):
    """In none of the plans of a usage count, written stages included, for any list of terms."""
    path = fresh_path(spark, "files")
    spark.createDataFrame([("r", "a.py", "import lib"), ("r", "a.go", "lib.x(")], "repo string, path string, content string").write.parquet(path)
    deps = spark.createDataFrame([("r", f"o/d{i}", [f"lib{i}", "lib"]) for i in range(300)], "repo string, dep string, terms array<string>")
    plans = []

    def kept(df):
        plans.append(df)
        return cut_lineage(df)

    monkeypatch.setattr(usage, "cut_lineage", kept)
    monkeypatch.setattr(containment, "cut_lineage", kept)
    files = spark.read.parquet(path)
    plans += [usage.usage_per_file(files, deps), usage.candidates(files, deps), usage.alias_use(files, deps)]
    assert len(plans) > 8
    for df in plans:
        assert not [line for line in exchanged(df) if "content" in line]


# ---- containment -------------------------------------------------------------------------

def test_contained_brute_force(spark):
    rng = random.Random(4)
    texts = {(f"r{rng.randrange(3)}", "".join(rng.choice("abcdé .") for _ in range(rng.randrange(0, 14)))) for _ in range(300)}
    phrases = {(f"r{rng.randrange(3)}", "".join(rng.choice("abcdé .") for _ in range(rng.randrange(0, 7)))) for _ in range(200)}
    got = containment.contained(spark.createDataFrame(sorted(texts), "repo string, t string"),
                                spark.createDataFrame(sorted(phrases), "repo string, p string"), ["repo"], "t", "p")
    assert rows(got) == sorted(((r, t, p) for r, t in texts for q, p in phrases if r == q and p and p in t), key=repr)
    none = spark.createDataFrame([], "repo string, p string")
    assert containment.contained(spark.createDataFrame(sorted(texts), "repo string, t string"), none, ["repo"], "t", "p").count() == 0


def test_phrases_meet_texts_at_their_rarest_gram(spark):
    """Ten thousand names that share an owner: rows formed follow the matches, not the square."""
    names = [("mono", f"@company/package-{i:05d}x") for i in range(4000)]
    slugs = [("mono", f"@company/package-{i:05d}") for i in range(0, 4000, 4)]
    pairs = containment.contained(spark.createDataFrame(names, "repo string, n string"),
                                  spark.createDataFrame(slugs, "repo string, s string"), ["repo"], "n", "s")
    assert pairs.count() == 1000
    formed = sum(m.value() for m in joined_rows(pairs))
    assert formed < 4_000_000 / 4


def joined_rows(df):
    """Row counts of the joins of a plan that has run."""
    def walk(plan):
        if "Join" in plan.nodeName():
            yield plan.metrics().apply("numOutputRows")
        children = plan.children()
        for i in range(children.size()):
            yield from walk(children.apply(i))
        if plan.nodeName().startswith("AdaptiveSparkPlan"):
            yield from walk(plan.executedPlan())
        if "QueryStage" in plan.nodeName():
            yield from walk(plan.plan())

    execution = df._jdf.queryExecution()
    execution.executedPlan().executeCollect()
    return list(walk(execution.executedPlan()))


def test_contains_any_brute_force(spark):
    rng = random.Random(6)
    words = ["a", "ab", "abc", "theory", "Ün", "x.y", ""]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 8)))) for i in range(120)] + [(200, None), (201, "AB\nabc  a")]
    phrases = ["a", "AB", "b a", "theory x", "ün", ".", "the", "y", "abc abc", "  ", " a", "a a a a", "zz", ""]
    got = containment.contains_any(spark.createDataFrame(texts, "id int, t string"), "id", "t",
                                   spark.createDataFrame([(p,) for p in phrases], "p string"), "p")
    assert rows(got) == sorted(((i, p) for i, t in texts for p in phrases if t is not None and p and p.lower() in t.lower()), key=repr)
    assert not [x for x in exchanged(got) if "t#" in x and "text" in x]


@pytest.mark.parametrize("few", [0, 40])
def test_all_phrases_in_one_pass(spark, monkeypatch, few):
    monkeypatch.setattr(text, "FEW_PHRASES", few)
    rng = random.Random(8)
    phrases = ["fork", "forked", "forked from", "a", "or", "c++", "zk-", "wrapper (", "éa", "ork"]
    texts = ["".join(rng.choice(["fork", "ed", " from", "c+", "+", "zk", "-", "wrapper", " (", "é", "a", " "]) for _ in range(rng.randrange(0, 9))) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    found = df.select("t", text.keyword_hits(F.col("t"), phrases).alias("n")).collect()
    assert all(r.n == sum(p in (r.t or "").lower() for p in phrases) for r in found)
    kind = text.classify(F.lit("n"), F.col("t"), F.lit(""), F.lit("Go"), [
        ("one", 0.1, ["forked"], ["Rust"]), ("two", 0.2, ["fork"], []), ("three", 0.3, ["c++", "zk-"], ["Go"])], {})
    for r in df.select("t", kind.alias("k")).collect():
        t = (r.t or "").lower()
        assert r.k.category == ("two" if "fork" in t else "three" if "c++" in t or "zk-" in t else fixed.DEFAULT_CATEGORY)
    plan = df.select(text.classify(F.lit("n"), F.col("t"), F.lit(""), F.lit("Go")).alias("k"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "Contains" not in plan


# ---- resume and upsert -------------------------------------------------------------------

def test_few_rows_meet_a_huge_done_table(spark):
    keys = spark.range(200_000).selectExpr("id as k", "'x' as v")
    done = spark.range(0, 200_000, 40).selectExpr("id as k").union(spark.range(5).selectExpr("id as k"))
    told = prefilter.may_match(keys, done, "k")
    assert told.filter("_may").count() < 0.15 * 200_000
    got = joins.remaining(keys, done, "k")
    assert got.columns == ["k", "v"] and got.count() == 195_000 - 4 and got.filter("k % 40 = 0").count() == 0
    odd = spark.createDataFrame([(None,), (1,)], "k long")
    assert rows(joins.remaining(odd, odd.filter("false"), "k")) == [(1,), (None,)]
    assert rows(joins.remaining(odd, odd, "k")) == [(None,)]  # null equals nothing


def test_upsert_rewrites_only_what_it_touches(spark, tmp_path):
    source, out = tmp_path / "in", fresh_path(spark, "upsert")

    def land(values):
        spark.createDataFrame(values, "repo string, n int").coalesce(1).write.mode("append").parquet(str(source))

    def run(state="/state"):
        stream = spark.readStream.schema("repo string, n int").parquet(str(source))
        resume.upsert_batches(stream, lambda b: b, out + "/rows", out + state, "repo", buckets=16)

    def files():
        return {os.path.join(d, x) for d, _, names in os.walk(out.removeprefix("file://") + "/rows") for x in names if x.endswith(".parquet")}

    land([(f"r{i}", i) for i in range(60)] + [("r1", 100), (None, 7)])
    run()
    before = files()
    land([("r1", 5), ("new", 6), (None, 8)])
    run()
    run()
    table = spark.read.parquet(out + "/rows")
    want = sorted([(f"r{i}", i) for i in range(60) if i != 1] + [("r1", 5), ("new", 6), (None, 8)], key=repr)
    assert rows(table.select("repo", "n")) == want
    touched = {r[0] for r in spark.createDataFrame([("r1",), ("new",), (None,)], "repo string").select(
        F.pmod(F.xxhash64("repo"), F.lit(16))).collect()}
    kept = {x for x in before if int(x.split("_bucket=")[1].split("/")[0]) not in touched}
    assert kept and kept <= files()
    batch = spark.createDataFrame([("r1", 5), ("new", 6), (None, 8)], "repo string, n int")
    resume.upsert(batch, out + "/rows", "repo", 16)  # repeated
    assert rows(spark.read.parquet(out + "/rows").select("repo", "n")) == want


# ---- summaries, readers, session ---------------------------------------------------------

def test_sketches_merge(spark):
    rng = random.Random(2)
    values = [(i % 3, rng.gauss(0, 1) ** 3) for i in range(30_000)] + [(0, None)]
    df = spark.createDataFrame(values, "g int, x double")
    parts = None
    for k in range(5):
        one = cut_lineage(aggregates.sketches(df.filter(F.pmod(F.xxhash64("x"), F.lit(5)) == k), "x", ["g"]))
        parts = one if parts is None else parts.union(one)
    shares = {"p10": 0.1, "p50": 0.5, "p99": 0.99}
    merged = aggregates.merged_sketches(parts, ["g"])
    for r in merged.select("g", "n", *[c.alias(n) for n, c in aggregates.sketched_quantiles(merged, shares).items()]).collect():
        own = sorted(x for g, x in values if g == r.g and x is not None)
        assert r.n == len(own) and abs(r["mean"] - sum(own) / len(own)) < 1e-9
        for name, q in shares.items():
            assert abs(sum(x <= r[name] for x in own) / len(own) - q) < aggregates.RANK_ERROR + 1 / len(own)


def test_one_giant_adjacency_object_is_split(spark, tmp_path):
    graph = {f"https://x/{i}": [f"https://y/{j}\"q" for j in range(i % 5)] for i in range(60_000)}
    path = tmp_path / "graph.json"
    path.write_text(json.dumps(graph))
    (tmp_path / "pretty.json").write_text(json.dumps(dict(list(graph.items())[:50]), indent=2))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512k")
    try:
        found = readers.read_giant_edges(spark, str(path))
        assert found.rdd.getNumPartitions() >= 4
        assert rows(found) == sorted(((s, t) for s, ts in graph.items() for t in ts), key=repr)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    assert readers.read_giant_edges(spark, str(tmp_path / "pretty.json")).count() == sum(len(t) for t in list(graph.values())[:50])
    (tmp_path / "bad.json").write_text('{"a": ["b"], oops ["c"]}')
    with pytest.raises(Exception, match="no entry of an adjacency object"):
        readers.read_giant_edges(spark, str(tmp_path / "bad.json")).collect()


def test_payload_is_parsed_once(spark):
    landed = spark.createDataFrame([
        ("https://github.com/A/b", "repo", '{"stargazers_count": 3, "topics": ["x", "y"], "license": {"spdx_id": "MIT"}}', None, 1),
        ("https://github.com/A/b", "repo", '{"stargazers_count": "lots", "fork": true}', None, 2),
        ("https://github.com/A/b", "tree", '{"tree": [{"path": "README.md", "type": "blob", "size": 9}, {"path": "src", "type": "tree"}]}', None, 1),
        ("https://github.com/A/b", "languages", '{"Go": 3, "C": 1}', None, 1), ("https://github.com/A/b", "languages", "nonsense", None, 3),
        ("https://github.com/A/b", "commits", "[{}]", '<u?page=41>; rel="last"', 1), ("https://github.com/c/d", "tree", '{"tree": []}', None, 1),
    ], "repo_url string, kind string, payload string, header string, landed int")
    typed = project_row.typed_payloads(landed)
    plan = typed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1
    wide, audit = project_row.collected(landed, "2025-01-01T00:00:00Z")
    r, = wide.collect()
    assert len(wide.columns) == 77
    assert (r.owner, r.repo_name, r.full_name, r.stars, r.is_fork, r.topics, r.license) == ("A", "b", "A/b", 0, True, "", "")
    assert (r.total_files, r.total_dirs, r.readme_size, r.total_commits, r.languages_count) == (1, 1, 9, 41, 0)
    assert rows(audit.select("kind", "landed", "path", "found")) == [("languages", 3, "$", ""), ("repo", 2, "$.stargazers_count", '"lots"')]
    first = project_row.collected(landed.filter("landed = 1"), "2025-01-01T00:00:00Z")[0].first()
    assert (first.stars, first.topics, first.license, first.languages_count, first.total_code_bytes) == (3, "x,y", "MIT", 2, 4)


def test_files_of_zero_bytes_count(spark, tmp_path):
    """A reader of the folder does not see them, the listed tree does."""
    root = tmp_path / "trees"
    (root / "p" / "src").mkdir(parents=True)
    (root / "p" / "src" / "a.py").write_text("import lib\n")
    (root / "p" / "src" / "__init__.py").write_text("")
    files = readers.read_source_tree(spark, str(root))
    tree = {"tree": [{"path": "src/a.py", "type": "blob", "size": 11}, {"path": "src/__init__.py", "type": "blob", "size": 0},
                     {"path": "src", "type": "tree"}, {"path": "README.md", "type": "blob", "size": 3}]}
    landed = spark.createDataFrame([("p", "tree", '{"tree": []}', None, 1), ("p", "tree", json.dumps(tree), None, 2)],
                                   "repo_url string, kind string, payload string, header string, landed int")
    listing = project_row.listed_files(cut_lineage(project_row.typed_payloads(landed)))
    deps = spark.createDataFrame([("p", "o/lib", ["lib"])], "repo string, dep string, terms array<string>")
    none = spark.createDataFrame([], "repo string, dep string, is_dev boolean")
    assert usage.usage_scores(files, deps, none).first().file_count == 1
    found = usage.usage_scores(files, deps, none, listing=listing).first()
    assert (found.file_count, found.total_imports) == (2, 1)


def test_folder_of_the_stages(spark):
    class Unset:
        get = staticmethod(lambda *_: None)

    class Far:
        conf = Unset

        class sparkContext:
            applicationId, master = "far", "spark://x"

    class Near(Far):
        class sparkContext:
            applicationId, master = "near", "local[2]"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Far)
    assert os.path.isdir(shared_folder(Near)) and shared_folder(Near) == shared_folder(Near)
    assert fresh_path(spark, "x").startswith(stage_root(spark))
    assert cut_lineage(spark.range(5)).count() == 5 and drop_stages(spark) and not drop_stages(spark)


# ---- plans and published values ----------------------------------------------------------

def test_bucketed_tables_assemble_without_an_exchange(spark):
    from lodestone.plans.registry import runner

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = runner("bucketed_assembly")(spark, "/root/testdata/sf0.001")
        df.collect()
        assert not exchanged(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["usage_scores", "project_rows", "large_dictionary", "originality_pipeline", "manifest_match", "remaining_keys"])
def test_plans_have_no_hazards(spark, name):
    from plans import hazards, plan_of

    from lodestone.plans.registry import runner

    assert hazards(plan_of(runner(name)(spark, "/root/testdata/sf0.001"))) == []


#: Published rows, numbers only: counted dependencies, age, packages of two kinds of lock file,
#: registry, and the age-adjusted count, producer, consumer and ratio made of them.
PUBLISHED = [
    (61, 3.9, 0, 110, None, 15.4, 0.0, 0.429, 0.0), (72, 3.7, None, None, "NPM", 46.6, 0.247, 0.592, 0.094),
    (12, 3.8, None, None, None, 7.7, 0.0, 0.331, 0.0), (224, 8.4, 0, 580, None, 43.1, 0.0, 0.58, 0.0),
    (32, 10.5, None, None, None, 15.4, 0.0, 0.428, 0.0), (0, 7.4, None, None, None, 0.0, 0.0, 0.0, 0.0),
    (160, 3.8, 881, 0, None, 30.6, 0.0, 0.529, 0.0), (341, 2.9, 664, 0, "CARGO", 75.3, 0.0, 0.664, 0.0),
    (9, 3.5, None, None, "PYPI", 6.0, 0.402, 0.298, 0.267), (90, 6.2, None, None, "NPM", 45.6, 0.247, 0.589, 0.095),
    (5, 5.7, 0, 0, "CARGO", 2.6, 0.428, 0.197, 0.38), (270, 4.9, None, None, None, 151.9, 0.0, 0.771, 0.0)]
MOST = 681.6  # largest published age-adjusted count


def test_published_counts_and_scores(spark):
    from lodestone.functions import numeric
    from lodestone.operators import graph

    df = spark.createDataFrame([(i, *map(float, r[:2]), *r[2:4], r[4] or "", *r[5:]) for i, r in enumerate(PUBLISHED)],
                               "id int, deps double, age double, cargo int, go int, eco string, adjusted double, p double, c double, r double")
    scale = numeric.ecosystem_factor(F.coalesce("cargo", F.lit(0)), F.coalesce("go", F.lit(0)), F.col("eco"))
    for r in df.withColumn("got", numeric.age_adjusted(F.col("deps") * scale, F.col("age"))).collect():
        assert abs(r.got - r.adjusted) <= max(0.3, 0.03 * r.adjusted), r
    nodes = df.select("id", F.col("adjusted").alias("age_adj_dep_count")).union(spark.createDataFrame([(99, MOST)], "id int, n double"))
    consumer = {r.id: r.consumer_score for r in graph.consumer_score(nodes).collect()}
    assert all(abs(consumer[i] - r[7]) < 0.004 for i, r in enumerate(PUBLISHED))
    best = 0.428 / (0.197 + 0.1) / 0.38  # of all published rows, from one of them
    assert all(abs(r[6] / (r[7] + 0.1) / best - r[8]) < 0.004 for r in PUBLISHED)
