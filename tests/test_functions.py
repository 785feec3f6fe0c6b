"""Column functions against expectations worked out by hand."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import keys, numeric, paths, payloads, text


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


def column(spark, rows, schema, expression):
    return [r["x"] for r in spark.createDataFrame(rows, schema)
            .select("i", expression.alias("x")).orderBy("i").collect()]


def test_ages(spark):
    rows = list(enumerate([
        "2000-01-01T00:00:00Z", "2000-01-01 00:00:00", "2000-01-01", "2000-01-01T02:00:00+02:00",
        "2003-12-31T23:00:00Z", "2030-01-01", "", "nan", "soon", None,
        "1999-12-31T22:30:00-0130"]))
    ages = column(spark, rows, "i int, s string",
                  numeric.age_years(F.col("s"), "2004-01-01T00:00:00Z"))
    four = 1461 / 365.25
    assert ages == pytest.approx([four, four, four, four, 0.1, 0.1, 1.0, 1.0, 1.0, 1.0, four])


def test_age_ignores_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert one(spark, numeric.epoch_seconds(F.col("s")), s="1970-01-02") == 86400
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_first_positive_skips_zero_and_null(spark):
    rows = [(0, 0, None, 5, 9), (1, 3, 4, 5, 9), (2, 0, 0, 0, 9), (3, None, None, None, 0)]
    got = column(spark, rows, "i int, a int, b int, c int, d int", numeric.first_positive(
        [F.col("a"), F.col("b"), F.col("c")], F.col("d")))
    assert got == [5, 3, 9, 0]


def test_scale_follows_presence(spark):
    rows = [(0, 5, 7, "MAVEN"), (1, 0, 7, "MAVEN"), (2, 0, 0, "npm,maven"), (3, None, None, None)]
    got = column(spark, rows, "i int, c int, g int, e string",
                 numeric.ecosystem_factor(F.col("c"), F.col("g"), F.col("e")))
    assert got == [0.30, 0.40, 0.80, 1.0]


def test_soft_cap_is_monotone_and_continuous(spark):
    xs = [0.1, 0.32, 0.5, 0.7799999, 0.78, 0.7800001, 0.9, 1.5]
    got = column(spark, list(enumerate(xs)), "i int, v double",
                 numeric.soft_cap(F.col("v"), F.lit(0.78)))
    assert got == sorted(got) and got[0] == 0.32
    assert abs(got[3] - got[5]) < 1e-6 and got[6] == pytest.approx(0.78 + 0.12 * 0.4)


def test_clip_keeps_null_and_numbers_are_lenient(spark):
    assert column(spark, [(0, None), (1, 9.0), (2, -9.0)], "i int, v double",
                  numeric.clip(F.col("v"), 0.0, 1.0)) == [None, 1.0, 0.0]
    assert column(spark, [(0, "1.5"), (1, "x"), (2, None), (3, "NaN"), (4, "")],
                  "i int, v string", numeric.to_number(F.col("v"))) == [1.5, 0, 0, 0, 0]


def test_keys(spark):
    url = " https://github.com/Acme/Tool/ \n"
    assert one(spark, keys.slug(F.col("u")), u="https://GitHub.com/Acme/Tool/") == "acme/tool"
    assert one(spark, keys.slug_keep_case(F.col("u")), u="https://github.com/Acme/Tool/") == "Acme/Tool"
    assert one(spark, keys.canonical(F.col("u")), u=url) == "https://github.com/Acme/Tool"
    assert one(spark, keys.canonical(F.col("u")), u="Acme/Tool/") == "https://github.com/Acme/Tool"
    owner, name = keys.owner_and_name(F.col("u"))
    assert one(spark, F.concat_ws("|", owner, name), u="http://github.com/a/b/tree") == "a|b"
    assert one(spark, owner, u="https://gitlab.com/a/b") is None
    assert one(spark, keys.leaf(F.col("u")), u="a/b/c") == "c"


def test_paths(spark):
    names = ["tests/a.rs", "test/a.rs", "src/spec/a.go", "latest/x.go", "vendor/x.py", "test.py",
             "src/x.RS", "core/test", "a/.rs", "a/Vendor/b.py", "test_data/x.go"]
    rows = list(enumerate(names))
    assert column(spark, rows, "i int, p string", paths.weight(F.col("p"))) == [
        0.3, 0.3, 2.0, 0.3, 1.0, 1.0, 2.0, 2.0, 1.0, 1.0, 0.3]
    assert column(spark, rows, "i int, p string", paths.bucket(F.col("p"))) == [
        "normal", "test", "test", "normal", "normal", "normal", "core", "test", "normal", "normal",
        "normal"]
    assert column(spark, rows, "i int, p string", paths.in_skipped_dir(F.col("p"))) == [
        False, False, False, False, True, False, False, False, False, True, True]
    assert column(spark, rows, "i int, p string", paths.file_language(F.col("p"))) == [
        "rust", "rust", "go", "go", "python", "python", "rust", None, None, "python", "go"]


def test_classify_rules_and_overrides(spark):
    rows = [(0, "Plonky3", "docker", None, None), (1, "x", "a ZKVM and kubernetes", None, None),
            (2, "x", "an Ethereum client", None, "Python"), (3, "x", "an Ethereum client", None, "Go"),
            (4, "x", "ethereum node, a consensus client", None, "Python"), (5, "x", None, None, "Go"),
            (6, "x", "", "kubernetes,helm", None), (7, "plonky3", "", None, None)]
    got = column(spark, rows, "i int, n string, d string, t string, l string", text.classify(
        F.col("n"), F.col("d"), F.col("t"), F.col("l")))
    assert [tuple(g) for g in got] == [
        ("zk_system", 0.0), ("zk_system", 0.06), ("general", 0.0), ("execution_client", 0.05),
        ("consensus_client", 0.05), ("general", 0.0), ("config_infra", -0.04), ("general", 0.0)]


def test_readme_signal_counts_distinct_phrases(spark):
    assert one(spark, text.readme_signal(F.col("t")), t="ZK zk circuit Compiler") == 3
    assert one(spark, text.readme_signal(F.col("t")), t="docker helm yaml scaffold toolkit") == -3
    assert one(spark, text.readme_signal(F.col("t")), t=None or "") == 0


def test_search_terms(spark):
    def terms(dep, language):
        return sorted(one(spark, text.search_terms(F.col("d"), F.col("l")), d=dep, l=language))

    assert terms("acme/rust-smallvec-core", "Rust") == [
        "rust-smallvec-core", "rust_smallvec_core", "smallvec"]
    assert terms("acme/go-redis", "Go") == ["go-redis", "redis"]
    assert terms("acme/io", "") == [] and terms("solo", "") == ["solo"]


def test_markdown_and_excerpt(spark):
    source = ("# Head\n![i](a.png) [link](http://x.y) **bold** _it_ `code`\n```py\nx\n```\n"
              "| a | b |\n|---|---|\n- item\n***\n<b>t</b> https://z.z/q\n\n\n\nend  here ")
    clean = one(spark, text.strip_markdown(F.col("t")), t=source)
    assert clean.startswith("Head") and clean.endswith("end here")
    for gone in ("#", "[", "`", "|", "<", "http", "*", "- item", "code"):
        assert gone not in clean
    assert "link bold it" in clean and "item" in clean
    short, long = text.excerpt(F.lit("a" * 79)), text.excerpt(F.lit("b" * 799 + "  c"))
    assert one(spark, short["readme_excerpt"], z=1) == "" and not one(spark, short["readme_found"], z=1)
    assert one(spark, long["readme_excerpt"], z=1) == "b" * 799


def test_base64_bad_bytes_and_bad_text(spark):
    assert one(spark, text.decode_base64(F.col("b")), b="Y2Fm\nw6k=") == "café"
    assert one(spark, text.decode_base64(F.col("b")), b="YfhiYw==") == "a�bc"
    assert one(spark, text.decode_base64(F.col("b")), b="***") is None


def test_series_links_and_maps(spark):
    assert one(spark, payloads.recent_mean(F.array(*[F.lit(float(i)) for i in range(6)])), z=1) == 3.5
    assert one(spark, payloads.recent_mean(F.array(F.lit(1.0))), z=1) == 0.0
    header = '<x?page=2>; rel="next", <x?page=57>; rel="last"'
    assert one(spark, payloads.link_total(F.lit(header), F.lit(1)), z=1) == 57
    assert one(spark, payloads.link_total(F.lit(None).cast("string"), F.lit(3)), z=1) == 3
    shares = payloads.language_shares(F.from_json(F.lit('{"Rust": 75, "C": 25}'), "map<string,bigint>"))
    assert one(spark, shares["primary_language_pct"], z=1) == 75.0
    empty = payloads.language_shares(F.from_json(F.lit("{}"), "map<string,bigint>"))
    assert one(spark, empty["primary_language_pct"], z=1) == 0.0
