"""Operators on small fixtures, against brute force where SQL is no check."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lodestone.functions import fixed
from lodestone.operators import (
    aggregates, features, graph, joins, manifests, pipeline, ranking, scoring, tree, tuning, usage,
)
from lodestone.session import fresh_path, shared_folder
from lodestone.sources import readers, writers
from lodestone.streaming import resume


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ---- joins, ranking ----------------------------------------------------------------------

def test_skewed_join_equals_join(spark):
    left = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id"))
                                    .alias("k"), F.col("id").alias("v"))
    right = spark.range(4000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    for how in ("inner", "left"):
        got = joins.skewed_join(left, right, "k", F.col("v"), how, salts=5, limit=100)
        assert rows(got.select("k", "v", "w").fillna(-1)) == rows(
            left.join(right, "k", how).select("k", "v", "w").fillna(-1))
    assert [r["k"] for r in joins.hot_keys(left, "k", 100).collect()] == [7]


def test_duplicate_keys_fail_loudly(spark):
    base = spark.createDataFrame([(1,)], "k int")
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(PySparkException):
        joins.assemble(base, [(twice, ["v"])], "k").collect()


def test_anchor_join_case(spark):
    jury = spark.createDataFrame([("acme/tool", 0.5), ("Acme/Other", 0.6)], "repo string, y double")
    known = spark.createDataFrame([("https://github.com/Acme/Tool",),
                                   ("https://github.com/Acme/Other",)], "repo_url string")
    assert joins.anchor_join(jury, known).count() == 1
    assert joins.anchor_join(jury, known, case_insensitive=True).count() == 2


def test_first_per_group_is_exact_under_skew(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2500, 0).otherwise(F.col("id") % 5)
                                  .alias("g"), F.hash("id").alias("o"), "id")
    got = ranking.first_per_group(df, ["g"], [F.col("o"), F.col("id")], 40, F.col("id"), salts=7)
    by_group = {}
    for r in sorted(df.collect(), key=lambda r: (r["o"], r["id"])):
        by_group.setdefault(r["g"], []).append(r["id"])
    want = sorted((g, i, n + 1) for g, ids in by_group.items() for n, i in enumerate(ids[:40]))
    assert sorted((r["g"], r["id"], r["rn"]) for r in got.collect()) == want


def test_ordered_text_across_runs(spark):
    df = spark.range(30).select(F.lit("a").alias("k"), F.col("id").alias("ord"),
                                F.col("id").cast("string").alias("t"))
    assert aggregates.ordered_text(df, ["k"], "ord", "t", width=4).first()["t"] == ",".join(
        str(i) for i in range(30))


# ---- features ----------------------------------------------------------------------------

def test_unified_count_priority_proxy_scale(spark):
    data = [("graph+go", 100, 0, 5, 9, 1, None), ("cargo", 0, 50, 0, 9, 1, None),
            ("maven", 0, 0, 0, 10, 1, "MAVEN"), ("manifest", 0, 0, 0, 0, 4, None),
            ("blst", 0, 0, 0, 0, 0, None), ("libBLS", 0, 0, 0, 0, 3, None),
            ("other", 0, 0, 0, 0, None, None)]
    df = spark.createDataFrame(data, "repo_name string, graph_dep_count int, "
                               "cargo_lock_total_packages int, go_sum_unique_modules int, "
                               "depsdev_transitive_deps int, dependency_count int, "
                               "depsdev_ecosystem string")
    got = {r["repo_name"]: (r["unified_dep_count"], r["scaled_dep_count"])
           for r in features.with_unified_count(df).collect()}
    assert got == {"graph+go": (100, 40), "cargo": (50, 15), "maven": (10, 8),
                   "manifest": (4, 4), "blst": (20, 20), "libBLS": (3, 3), "other": (0, 0)}


def test_missing_age_column(spark):
    assert features.with_age(spark.range(1), "2020-01-01").first()["repo_age_years"] == 3.0


# ---- graph -------------------------------------------------------------------------------

def brute_producer(edges, nodes, passes):
    known = [(s, d) for s, d in edges if s in nodes and d in nodes]
    score = {n: sum(d == n for _, d in known) for n in nodes}
    top = max(score.values())
    score = {n: (v / (top + 1e-9)) ** 0.5 for n, v in score.items()}
    for _ in range(passes - 1):
        score = {n: sum(score[s] for s, d in known if d == n) for n in nodes}
        top = max(score.values())
        score = {n: (v / (top + 1e-9)) ** 0.5 for n, v in score.items()}
    return {n: round(v, 4) for n, v in score.items()}


@pytest.mark.parametrize("passes", [1, 2, 4])
def test_producer_score_brute_force(spark, passes):
    rng = random.Random(passes)
    edges = [(rng.randrange(12), rng.randrange(14)) for _ in range(60)]
    edges += [(1, 2), (1, 2), (3, 3), (99, 1), (0, 98)] + [(5, d) for d in range(10)]
    nodes = list(range(13)) + [50]
    got = graph.producer_score(spark.createDataFrame(edges, "src int, dst int"),
                               spark.createDataFrame([(n,) for n in nodes], "id int"), passes)
    want = brute_producer(edges, set(nodes), passes)
    assert {r["id"]: r["producer_score"] for r in got.collect()} == pytest.approx(want, abs=1e-4)


# ---- manifests ---------------------------------------------------------------------------

def names(spark, path, content):
    df = spark.createDataFrame([("r", path, content)], "repo string, path string, content string")
    return {(r["dep"], r["is_dev"]) for r in manifests.extract_all(df).collect()}


def test_toml_quirks(spark):
    got = names(spark, "a/Cargo.toml", "[dependencies.foo-x]\nversion = \"1\"\n[build-dependencies]\n"
                "cc = 1\n# no = 1\n[dev-dependencies]\nrand_x.workspace = true\n[other]\nz = 1")
    assert got == {("version", False), ("cc", False), ("rand_x", True)}
    assert names(spark, "vendor/Cargo.toml", "[dependencies]\na = 1") == set()


def test_go_npm_python_dotnet(spark):
    assert names(spark, "go.mod", "require x.y/z v1\nrequire (\n a.b/c v2\n // d v1\n)") == {
        ("x.y/z", False), ("a.b/c", False)}
    assert names(spark, "package.json", '{"dependencies": {"a": "1", "b": {"x": 1}}, '
                 '"devDependencies": {"c": "1"}}') == {("a", False), ("b", False), ("c", True)}
    assert names(spark, "package.json", "{broken") == set()
    assert names(spark, "Godeps.json", '{"Deps": [{"ImportPath": "a/b/c/d"}, {"X": 1}]}') == {
        ("a/b/c/d", False), ("a/b/c", False)}
    assert names(spark, "requirements-dev.txt", "# x\nFoo-Bar>=1\n\n  baz [x]\n") == {
        ("foo_bar", False), ("baz", False)}
    assert names(spark, "x.csproj", '<packagereference Include="A.B-c"/>') == {
        ("A.B-c", False), ("a.b-c", False), ("a_b_c", False)}


def test_cheap_counts_treat_build_dependencies_as_dev(spark):
    text = "[dependencies]\na = 1\n#b = 1\n[build-dependencies]\nc = 1\n[package]\nd = 1"
    row = spark.createDataFrame([("cargo", text), ("npm", "{broken"), ("pip", "a\n#b\n-c\n\n  d"),
                                 ("zig", "a = 1")], "k string, t string")
    prod, dev = manifests.manifest_counts(F.col("k"), F.col("t"))
    got = {r["k"]: (r["p"], r["d"]) for r in row.select("k", prod.alias("p"), dev.alias("d")).collect()}
    assert got == {"cargo": (1, 1), "npm": (0, 0), "pip": (2, 0), "zig": (0, 0)}


def test_match_declared_brute_force(spark):
    rng = random.Random(3)
    parts = ["ab", "a", "b-c", "b_c", "x.y", "abc"]
    slugs = [f"{rng.choice(parts)}/{rng.choice(parts)}" for _ in range(30)] + ["ab", "b-c"]
    found = ["/".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(40)]
    deps = sorted({(f"r{i % 3}", s, (s.split("/")[-1],)) for i, s in enumerate(slugs)})
    named = sorted({(f"r{i % 3}", n.upper() if i % 5 == 0 else n, i % 2 == 0)
                    for i, n in enumerate(found)})

    def norm(s):
        return s.lower().replace("-", "_").replace(".", "_")

    def hit(repo, slug, terms, dev):
        return any(slug.lower() in n.lower() or norm(n) in [norm(t) for t in terms]
                   for r, n, d in named if r == repo and d == dev)

    got = manifests.match_declared(
        spark.createDataFrame([(r, s, list(t)) for r, s, t in deps],
                              "repo string, dep string, terms array<string>"),
        spark.createDataFrame(named, "repo string, dep string, is_dev boolean"))
    assert rows(got.select("repo", "dep", "in_prod", "in_dev")) == sorted(
        (r, s, hit(r, s, t, False), hit(r, s, t, True)) for r, s, t in deps)


# ---- usage -------------------------------------------------------------------------------

def counts(spark, language, content, terms):
    df = spark.createDataFrame([(content, terms, language)], "c string, t array<string>, l string")
    return tuple(df.select(usage.usage_in_text(F.col("c"), F.col("t"), F.col("l")).alias("u"))
                 .first()["u"])


def test_usage_patterns(spark):
    assert counts(spark, "rust", "use serde::x;\nextern crate serde;\nserde::to(1);\n"
                  "#[derive(serde, B)]\nmyserde::x", ["serde"]) == (2, 0, 3)
    go = 'import "a.b/go-redis"\nr "a.b/go-redis"\ngoredis.New(1)\n'
    assert counts(spark, "go", go, ["a.b/go-redis"]) == (3, 2, 1)
    py = "import numpy as np\nfrom numpy import x as nx\nnp.a(1)\nnp.b\nnumpy.c(2)\nnx.z\n"
    assert counts(spark, "python", py, ["numpy"]) == (2, 1, 4)
    js = "import type from 'lib'\nconst q = require('lib')\nimport * as ll from 'lib'\nll.a();\n"
    assert counts(spark, "typescript", js, ["lib"]) == (3, 1, 1)
    assert counts(spark, "cpp", '"a/lib.h"\nlib::x lib.y', ["lib"]) == (1, 0, 2)
    assert counts(spark, "python", "import éa\nimport a.b\n", ["a.b", "q\\Ex"]) == (1, 0, 0)


def test_unicode_word_edges(spark):
    assert counts(spark, "ruby", "éfoo.bar foo.é", ["foo"]) == (0, 0, 1)


def scan(spark, files, deps, **options):
    f = spark.createDataFrame(files, "repo string, path string, content string")
    d = spark.createDataFrame(deps, "repo string, dep string, terms array<string>")
    return usage.usage_per_file(f, d, **options)


def test_every_match_of_many_dependencies_counts(spark):
    files = [("r", f"src/{i}.py", f"import d{i % 150}\n") for i in range(300)]
    files += [("s", "a.py", "import d1\n"), ("s", "vendor/a.py", "import d1\n"),
              ("s", "b.py", " \n"), ("s", "a.txt", "import d1\n")]
    deps = [("r", f"x/d{i}", [f"d{i}"]) for i in range(150)] + [("s", "x/d1", ["d1"])]
    assert len(rows(scan(spark, files, deps))) == 301


def test_capped_list_prefers_core_and_drops_tests(spark):
    files = ([("r", f"test/{i}.py", "import dd\n") for i in range(5)]
             + [("r", f"x/{i}.py", "import dd\n") for i in range(5)]
             + [("r", f"src/{i}.py", "import dd\n") for i in range(5)])
    frame = spark.createDataFrame(files, "repo string, path string, content string")
    assert sorted(r["path"] for r in usage.capped_files(frame, 7).collect()) == [
        f"src/{i}.py" for i in range(5)] + ["x/0.py", "x/1.py"]


def test_every_file_of_a_large_project_counts(spark):
    files = [("r", f"test/{i}.py", "import dd\n") for i in range(2300)] + [("r", "blank.py", " ")]
    frame = spark.createDataFrame(files, "repo string, path string, content string")
    deps = spark.createDataFrame([("r", "a/dd", ["dd"])], "repo string, dep string, terms array<string>")
    none = spark.createDataFrame([], "repo string, dep string, is_dev boolean")
    got = usage.usage_scores(frame, deps, none).first()
    assert (got["total_imports"], got["file_count"]) == (2300, 2301)


def test_go_prefilter_changes_result(spark):
    files = [("r", "a.go", 'goredis.New(1)'), ("r", "b.go", '// a.b/go-redis\ngoredis.New(1)')]
    got = scan(spark, files, [("r", "a/x", ["a.b/go-redis"])])
    assert [(r["path"], r["calls"]) for r in got.collect()] == [("b.go", 1)]


def test_usage_scores_penalty_and_unused(spark):
    call = "lib.a(1)\n"
    files = [("r", "test/t.py", call * 5), ("s", "test/t.py", call * 6), ("u", "src/a.py", "x = 1")]
    deps = [(r, "o/lib", ["lib"]) for r in "rsu"]
    names_ = spark.createDataFrame([("s", "lib", True), ("u", "lib", False)],
                                   "repo string, dep string, is_dev boolean")
    got = {r["repo"]: r for r in usage.usage_scores(
        spark.createDataFrame(files, "repo string, path string, content string"),
        spark.createDataFrame(deps, "repo string, dep string, terms array<string>"), names_).collect()}
    import math
    assert got["r"]["weighted_score"] == pytest.approx(0.3 * math.log1p(15))
    assert got["s"]["weighted_score"] == pytest.approx(0.5 * (0.9 + 0.15 * 0.3 * math.log1p(18)))
    assert got["u"]["weighted_score"] == 3.0 and not got["u"]["source_match"]


# ---- scores and tuning -------------------------------------------------------------------

def anchors(spark, n, seed, flat=False):
    rng = random.Random(seed)
    cats = list(fixed.CATEGORY_CAPS) + ["unknown"]
    data = []
    for i in range(n):
        r = [0.5 if flat else rng.random() for _ in range(16)]
        data.append((i, *r[:3], 0.01, rng.randrange(-3, 6), rng.random() < 0.5, *r[3:15],
                     rng.choice(cats), round(rng.random(), 3)))
    columns = ("id int, dep_score double, code_score double, contrib_score double, cat_bonus double, "
               "readme_tech_signal int, has_benchmarks boolean, ai_scratch double, "
               "ai_protocol double, ai_novel double, ai_found double, ai_wrapper double, "
               "ai_template double, star_score double, activity_score double, usage_signal double, "
               "producer_score double, consumer_score double, pc_ratio double, category string, "
               "target double")
    return spark.createDataFrame(data, columns)


def predicted(spark, df, weights, caps):
    found = scoring.scored(df, weights, caps).select("target", "originality").collect()
    return [(round(abs(r["originality"] - r["target"]) * 1e6)) for r in found]


def test_grid_takes_first_minimum_and_usage_axis_is_idle(spark):
    df = anchors(spark, 20, 1)
    table = {r["combo_id"]: r["error"] for r in tuning.grid_errors(df).collect()}
    assert len(table) == 1200 and all(table[i] == table[i - i % 4] for i in table)
    best = tuning.grid_search(df).first()
    low = min(table.values())
    assert best["combo_id"] == min(i for i, e in table.items() if e == low)
    weights = dict(fixed.WEIGHTS, dep_weight=best["dep_weight"], ai_wrapper_coef=best["wrapper_coef"])
    assert sum(predicted(spark, df, weights, tuning.grid_caps(best["cap"]))) == low
    free = {r["combo_id"]: r["error"] for r in tuning.grid_errors(df, faithful=False).collect()}
    assert free[2] == table[2] * 1 or free != table


@pytest.mark.parametrize("seed,flat", [(1, False), (2, False), (3, True), (4, False)])
def test_leave_two_out_brute_force(spark, seed, flat):
    df = anchors(spark, 24, seed, flat).cache()
    weights, caps = dict(fixed.WEIGHTS), dict(fixed.CATEGORY_CAPS)
    errors = [r["e"] for r in tuning.cv_error_vectors(df, weights, caps).collect()]
    n, total = len(errors), [sum(e[g] for e in errors) for g in range(12)]
    held = []
    for i, j in itertools.combinations(range(n), 2):
        left = [total[g] - errors[i][g] - errors[j][g] for g in range(12)]
        g = left.index(min(left))
        held += [errors[i][g], errors[j][g]]
    got = tuning.leave_two_out(df, weights, caps).first()
    assert got["pairs"] == n * (n - 1) // 2
    assert got["cv_mae"] == pytest.approx(sum(held) / len(held) / 1e6, abs=1e-12)


@pytest.mark.parametrize("n,copies,rows", [(24, 900, 512), (60, 1, 2)])
def test_leave_two_out_takes_all_anchors(spark, monkeypatch, n, copies, rows):
    monkeypatch.setattr(tuning, "BLOCK_ROWS", rows, raising=False)
    df = anchors(spark, n, 3, True).crossJoin(spark.range(copies).select(F.col("id").alias("copy"))).cache()
    weights, caps = dict(fixed.WEIGHTS), dict(fixed.CATEGORY_CAPS)
    vectors = Counter(tuple(r["e"]) for r in tuning.cv_error_vectors(df, weights, caps).collect())
    total = [sum(e[g] * m for e, m in vectors.items()) for g in range(12)]
    held = 0
    for (x, m), (y, k) in itertools.combinations_with_replacement(vectors.items(), 2):
        left = [total[g] - x[g] - y[g] for g in range(12)]
        g = left.index(min(left))
        held += (x[g] + y[g]) * (m * (m - 1) // 2 if x == y else m * k)
    got = tuning.leave_two_out(df, weights, caps).first()
    assert got["pairs"] == n * copies * (n * copies - 1) // 2
    assert got["cv_mae"] == pytest.approx(held / got["pairs"] / 2 / 1e6, abs=1e-12)


def test_cap_search_brute_force(spark):
    df = anchors(spark, 30, 8).cache()
    weights, caps = dict(fixed.WEIGHTS), tuning.grid_caps(0.76)
    row = tuning.cap_errors(df, weights, caps).first()
    best, best_id, stale = None, -1, 0
    sums = [row[c] for c in fixed.CAP_AXES]
    for i, combo in enumerate(itertools.product(*sums)):
        error = row["rest"] + sum(combo)
        if best is None or error < best - 500 * row["n"]:
            best, best_id, stale = error, i, 0
        else:
            stale += 1
            if stale >= 500:
                break
    all_errors = [row["rest"] + sum(combo) for combo in itertools.product(*sums)]
    whole = tuning.cap_search(df, weights, caps).first()
    assert whole["combo_id"] == all_errors.index(min(all_errors))
    assert whole["mae"] == pytest.approx(min(all_errors) / row["n"] / 1e6)
    got = tuning.cap_search(df, weights, caps, fixed.CAP_PATIENCE).first()
    assert got["combo_id"] == best_id and got["mae"] == pytest.approx(best / row["n"] / 1e6)
    refined = dict(caps, **{c: got[c] for c in fixed.CAP_AXES})
    assert sum(predicted(spark, df, weights, refined)) == best


def test_no_anchors_means_no_tuning(spark):
    assert tuning.tune(anchors(spark, 1, 1).limit(0)) is None


def test_config_penalty_comes_before_cap(spark):
    df = spark.createDataFrame([("config_infra", 0.72), ("config_infra", 0.60), ("other", 0.95),
                                ("data_repo", 0.10)], "category string, b double")
    got = [r["x"] for r in df.select(scoring.capped(F.col("b"), scoring.category_cap()).alias("x")).collect()]
    assert got == [0.628, 0.52, 0.89, 0.32]


def test_tree_quirks(spark):
    items = [("r", "latest/x.go", "blob", 1, 1), ("r", "README.md", "blob", 7, 2),
             ("r", "readme.txt", "blob", 9, 3), ("r", "a.b/c", "blob", 1, 4),
             ("r", "src", "tree", None, 5)]
    got = tree.tree_stats(spark.createDataFrame(
        items, "repo string, path string, type string, size int, ord int")).first()
    assert (got["test_file_count"], got["readme_size"], got["tree_depth"], got["has_tests"]) == (
        1, 7, 1, True)


# ---- sources, sinks, streams -------------------------------------------------------------

def test_csv_keeps_quotes_and_commas(spark):
    df = spark.createDataFrame([("a", 'say "hi", twice\nthen'), ("b", None)], "k string, v string")
    path = fresh_path(spark, "test")
    writers.write_csv(df, path)
    assert rows(readers.read_csv(spark, path, "k string, v string", multi_line=True).fillna("")) == rows(df.fillna(""))


def test_optional_source(spark):
    absent = readers.optional(lambda: readers.read_csv(spark, fresh_path(spark, "no"), "a int"),
                              spark, "a int")
    assert absent.count() == 0 and absent.columns == ["a"]


def test_read_source_tree(spark, tmp_path):
    for name, data in [("p/src/a.rs", b"fn \xff x"), ("p/b.txt", b"no"), ("q/c.Py", b"x"),
                       ("q/blank.go", b" \n")]:
        file = tmp_path / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(data)
    assert rows(readers.read_source_tree(spark, str(tmp_path))) == [
        ("p", "src/a.rs", "fn  x"), ("q", "blank.go", " \n"), ("q", "c.Py", "x")]


def test_read_edges(spark, tmp_path):
    """Each line is an object of adjacency lists; empty lists, null and broken lines give no edge."""
    (tmp_path / "a.json").write_text('{"u": ["v", "w"], "x": []}\n{"u": ["v"]}\n')
    (tmp_path / "b.json").write_text('{"y": null}\n{broken\n\n')
    assert rows(readers.read_edges(spark, str(tmp_path))) == [("u", "v"), ("u", "v"), ("u", "w")]


def test_read_manifest_tree(spark, tmp_path):
    """Manifests from a folder reach the extractor; vendored ones and other files do not count."""
    for name, data in [("p/Cargo.toml", "[dependencies]\nserde = 1\n"),
                       ("p/vendor/x/Cargo.toml", "[dependencies]\nhidden = 1\n"),
                       ("p/main.rs", "use serde;"), ("q/sub/requirements-dev.txt", "numpy>=1\n"),
                       ("q/notes.txt", "no"), ("r/a.csproj", '<PackageReference Include="Abc" />'),
                       ("r/package.json", "{}"), ("r/go.mod", "")]:
        file = tmp_path / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(data)
    found = readers.read_manifest_tree(spark, str(tmp_path))
    assert {r.path for r in found.select("path").collect()} == {
        "Cargo.toml", "vendor/x/Cargo.toml", "sub/requirements-dev.txt", "a.csproj", "package.json"}
    assert rows(manifests.extract_all(found)) == [
        ("p", "serde", False), ("q", "numpy", False), ("r", "Abc", False), ("r", "abc", False)]


def test_write_scores_agree(spark):
    df = anchors(spark, 5, 2).withColumns({
        "repo_url": F.concat(F.lit("u"), F.col("id")), "unified_dep_count": F.lit(3.0),
        "repo_age_years": F.lit(2.0), "age_adj_dep_count": F.lit(1.5), "direct_ratio": F.lit(1.0),
        "total_code_bytes": F.lit(12345), "language": F.lit("Go"), "stars": F.lit(4)})
    report, short = fresh_path(spark, "report"), fresh_path(spark, "short")
    writers.write_scores(scoring.scored(df), report, short)
    a = spark.read.option("header", True).csv(report)
    b = spark.read.option("header", True).csv(short)
    assert len(a.columns) == 15 and rows(a.select("repo", "originality")) == rows(b)


def test_two_batches_equal_one_run(spark, tmp_path):
    source, out = tmp_path / "in", fresh_path(spark, "batches")

    def land(values):
        spark.createDataFrame(values, "repo string, n int").coalesce(1).write.mode("append") \
            .parquet(str(source))

    def run():
        stream = spark.readStream.schema("repo string, n int").parquet(str(source))
        resume.run_batches(stream, lambda b: b.groupBy("repo").agg(F.sum("n").alias("n")),
                           out + "/rows", out + "/state")

    land([("a", 1), ("b", 2)])
    run()
    land([("a", 5), ("c", 3)])
    run()
    run()
    assert rows(resume.merged(spark, out + "/rows", ["repo"], ["n"])) == [("a", 6), ("b", 2), ("c", 3)]
    assert rows(resume.latest(spark, out + "/rows", ["repo"])) == [("a", 5), ("b", 2), ("c", 3)]


def test_resume_equals_one_shot(spark):
    keys = spark.createDataFrame([(k,) for k in "abcd"], "repo string")

    def work(todo):
        return todo.select("repo", F.lit("d").alias("dependency"), F.lit(1).alias("file_count"))

    old = spark.createDataFrame([("a", "d", 1), ("b", "d", -1)],
                                "repo string, dependency string, file_count int")
    assert rows(resume.resume(keys, old, work)) == rows(work(keys))


def test_shared_folder_is_the_sessions(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_folder(spark) == (named or shared_folder(spark)) and fresh_path(spark, "a").startswith(shared_folder(spark))


# ---- plans -------------------------------------------------------------------------------

def test_filters_and_columns_reach_the_scan(spark):
    from plans import plan_of

    path = fresh_path(spark, "usage")
    spark.range(5).selectExpr("id AS repo", "id AS dependency", "1.0 AS weighted_score",
                              "id AS file_count", "'x' AS extra").write.parquet(path)
    plan = plan_of(aggregates.top_dependencies(spark.read.parquet(path)))
    assert "PushedFilters: [IsNotNull(file_count), GreaterThanOrEqual(file_count,0)]" in plan
    assert "extra" not in plan and "TakeOrderedAndProject" in plan


def test_indented_comments_are_no_dependencies(spark):
    from lodestone.operators import manifests

    frame = spark.createDataFrame([("r", "requirements.txt", "foo>=1\n  # indented note\n  bar")],
                                  "repo string, path string, content string")
    assert {r["dep"] for r in manifests.extract_all(frame).collect()} == {"foo", "bar"}


def test_repeated_signals_keep_one_row(spark):
    from lodestone.operators import features

    base = spark.createDataFrame([("a",), ("b",)], "repo_url string")
    name = next(iter(fixed.SIGNALS.values()))
    signals = spark.createDataFrame([("a", "0.1"), ("a", "0.9")], f"repo_url string, {name} string").coalesce(1)
    short = next(iter(fixed.SIGNALS))
    got = {r["repo_url"]: r[short] for r in features.with_signals(base, signals, "repo_url").collect()}
    assert got == {"a": 0.9, "b": 0.0}
    landed = signals.withColumn("landed", F.when(F.col(name) == "0.1", 2).otherwise(1)).repartition(4)
    last = {r["repo_url"]: r[short] for r in features.with_signals(base, landed, "repo_url").collect()}
    assert last == {"a": 0.1, "b": 0.0}


def test_slugs_of_any_depth_are_found(spark):
    from lodestone.operators import containment, manifests

    long = "a" * 300 + "/mono/pkg"
    names_ = spark.createDataFrame([("r", "GitHub.com/acme/mono/pkg/v2", False), ("r", "xyz", True), ("r", long, True)],
                                   "repo string, dep string, is_dev boolean")
    wanted = ["acme/mono/pkg", "github.com/acme/mono/pkg", "pkg/v2", "y", "xz", "mono", long, long + "/x", ""]
    deps = spark.createDataFrame([("r", d, []) for d in wanted], "repo string, dep string, terms array<string>")
    got = {r["dep"]: (r["in_prod"], r["in_dev"]) for r in manifests.match_declared(deps, names_).collect()}
    assert got == {"acme/mono/pkg": (True, False), "github.com/acme/mono/pkg": (True, False), "pkg/v2": (True, False),
                   "y": (False, True), "xz": (False, False), "mono": (True, True), long: (False, True),
                   long + "/x": (False, False), "": (False, False)}
    name = spark.range(1).select(F.lit(long).alias("n"))
    assert name.select(F.size(containment.grams(F.col("n"), 4))).first()[0] < len(long)


def test_quantiles_brute_force(spark):
    values = [(g, float(v)) for g, n in (("a", 41), ("b", 2), ("c", 1), (None, 8))
              for v in [(i * 37 % 11) * 1.5 - 3 for i in range(n)]] + [("a", None), ("d", None)]
    df = spark.createDataFrame(values, "g string, v double").repartition(7)
    shares = {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q3": 0.9, "q4": 1.0}
    want = df.groupBy("g").agg(*[F.percentile("v", s).alias(n) for n, s in shares.items()])
    got = aggregates.quantiles(df, "v", shares, ["g"])
    assert {r["g"]: tuple(r)[1:] for r in got.collect()} == {
        r["g"]: tuple(r)[1:] for r in want.filter("q0 is not null").collect()}
    assert aggregates.spread(df, "g", "v").count() == 5
    assert aggregates.summary(df.limit(0), "v").first()["median"] is None
    plan = aggregates.spread(df, "g", "v")._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "median" not in plan


def test_hot_keys_are_spread_by_their_share(spark):
    left = spark.range(1000).select(F.when(F.col("id") < 500, "hot").when(F.col("id") > 900, None)
                                    .otherwise(F.col("id").cast("string")).alias("k"), "id")
    assert {r["k"]: r["_hot"] for r in joins.hot_keys(left, "k", 20).collect()} == {"hot": 10, None: 2}
    table = spark.createDataFrame([("hot", "x"), ("600", "y")], "k string, v string")
    got = joins.lookup_default(left, table, "k", "v", "none")
    assert {r["v"]: r["n"] for r in got.groupBy("v").agg(F.count("*").alias("n")).collect()} == {
        "x": 500, "y": 1, "none": 499}


def test_sparse_orders_are_joined_by_place(spark):
    df = spark.range(40).select((F.col("id") % 2).alias("k"), (F.col("id") * 10**12).alias("ord"),
                                F.col("id").cast("string").alias("t"), F.lit("z").alias("u"))
    got = aggregates.ordered_text(df, ["k"], "ord", "t", "u", width=5)
    assert rows(got.select("k", "t", "u")) == [
        (k, ",".join(str(i) for i in range(k, 40, 2)), ",".join("z" * 20)) for k in (0, 1)]


# ---- from partial tables to scores -------------------------------------------------------

HOST = "https://github.com/"


def partial_tables(spark):
    def frame(values, schema):
        return spark.createDataFrame(values, schema)

    projects = frame(
        [(HOST + f"acme/{n}", n, text, "Rust", "2020-01-01T00:00:00Z", stars, 10 * i, 3, 100_000, 7)
         for i, (n, text, stars) in enumerate([("Tool", "a compiler", 9), ("lib", "helm chart", 0), ("bare", None, 4)])],
        "repo_url string, repo_name string, description string, language string, created_at string, "
        "stars bigint, commits_last_year bigint, contributor_count bigint, total_code_bytes bigint, "
        "dependency_count bigint")
    graph = frame([(HOST + "Acme/Tool", [HOST + "acme/lib", HOST + "x/y", HOST + "x/z", HOST + "x/w"]),
                   (HOST + "acme/lib", [HOST + "acme/bare/"])], "src string, targets array<string>")
    direct = frame([(HOST + "acme/tool", [HOST + "acme/lib"])], "src string, targets array<string>")
    locks = frame([(HOST + "acme/lib", 0, 5)], "repo_url string, cargo_lock_total_packages bigint, go_sum_unique_modules bigint")
    registry = frame([(HOST + "acme/bare", "maven", 2, 8)], "repo_url string, depsdev_ecosystem string, "
                     "depsdev_direct_deps bigint, depsdev_transitive_deps bigint")
    usage_rows = frame([("acme/Tool", "d", 2.0, True), ("acme/Tool", "e", 0.0, False)],
                       "repo string, dependency string, weighted_score double, source_match boolean")
    readmes = frame([(HOST + "acme/Tool", "A compiler, formal. Docker"), (HOST + "acme/lib", None)],
                    "repo_url string, readme_excerpt string")
    signals = frame([(HOST + "acme/lib", "0.5"), (HOST + "acme/bare", "bad")],
                    "repo_url string, is_wrapper_or_integration string")
    return projects, dict(graph=graph, direct_graph=direct, locks=locks, registry=registry, usage=usage_rows,
                          readmes=readmes, signals=signals)


def test_features_from_partial_tables(spark):
    projects, tables = partial_tables(spark)
    got = {r["repo_name"]: r for r in pipeline.features(projects, "2024-01-01T00:00:00Z", **tables).collect()}
    assert len(got) == 3
    assert [got[n]["unified_dep_count"] for n in ("Tool", "lib", "bare")] == [4.0, 1.0, 8.0]
    assert [got[n]["scaled_dep_count"] for n in ("Tool", "lib", "bare")] == pytest.approx([4.0, 0.4, 6.4])
    assert [got[n]["direct_ratio"] for n in ("Tool", "lib", "bare")] == [0.25, 0.0, 0.25]
    assert [got[n]["dep_quality"] for n in ("Tool", "lib", "bare")] == pytest.approx(
        [math.log1p(0.25) / math.log1p(500), 0.0, 0.0])
    assert [got[n]["readme_tech_signal"] for n in ("Tool", "lib", "bare")] == [1, 0, 0]
    assert [got[n]["usage_signal"] for n in ("Tool", "lib", "bare")] == pytest.approx([0.75, 0.0, 0.0])
    assert [got[n]["ai_wrapper"] for n in ("Tool", "lib", "bare")] == [0.0, 0.5, 0.0]
    assert got["bare"]["producer_score"] > 0 == got["Tool"]["producer_score"]


def test_scores_with_and_without_tables(spark):
    projects, tables = partial_tables(spark)
    alone = pipeline.score(projects, "2024-01-01T00:00:00Z")
    assert {r["pc_ratio"] for r in alone.collect()} == {0.5} and alone.filter("originality is null").count() == 0
    jury = spark.createDataFrame([("acme/Tool", 0.7), ("acme/lib", 0.5), ("no/one", 0.1), ("acme/bare", None)],
                                 "repo string, average_originality double")
    tuned = pipeline.score(projects, "2024-01-01T00:00:00Z", jury, **tables)
    untuned = pipeline.score(projects, "2024-01-01T00:00:00Z", **tables)

    def off(df):
        score = {r["repo_name"]: r["originality"] for r in df.collect()}
        return abs(score["Tool"] - 0.7) + abs(score["lib"] - 0.5)

    assert off(tuned) <= off(untuned)
    assert pipeline.score(projects.limit(0), "2024-01-01T00:00:00Z", jury, **tables).count() == 0
