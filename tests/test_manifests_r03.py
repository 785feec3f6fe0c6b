"""Steps of the manifest queries that cost more than their input. Every test builds its own rows."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from lodestone.operators import manifests


def test_spellings_are_one_row_until_distinct(spark):
    """a name with dashes and the same with underscores are grouped as one row."""
    found = ["a-b", "a_b", "a-b_c", "a_b-c", "a-", "-", "_", "", "c", "c-d", "é-x", "a-b", "x.y-z", None]
    rows = [(k, [n, m], [m]) for k in ("r", "q", None) for n in found for m in found[:6]] + [("s", None, None)]
    df = spark.createDataFrame(rows, "repo string, prod array<string>, dev array<string>")
    got = manifests.exploded(df, F.struct("prod", "dev"))
    assert "bit_or" in got._jdf.queryExecution().optimizedPlan().toString()
    want = {(k, n, d) for k, prod, dev in rows for d, names in ((False, prod), (True, dev)) for n in names or []}
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(want) and set(got) == want
    text = "[dependencies]\na-b = 1\nc_d = 1\ne-f_g = 1\n[dev-dependencies]\na_b = 2\n"
    df = spark.createDataFrame([("r", text), ("r", text)], "repo string, content string")
    got = sorted(tuple(r)[1:] for r in manifests.extract(df, "toml").collect())
    assert got == [("a-b", False), ("a_b", False), ("a_b", True), ("c_d", False), ("e-f_g", False), ("e_f_g", False)]


def test_kinds_are_told_once(spark):
    """no filter on the kind below the path, which would be spelled out at each mention."""
    paths = ["Cargo.toml", "vendor/Cargo.toml", "x/package.json", "a/node_modules/package.json", "README", None]
    text = '{"dependencies": {"k": "1"}}\n[dependencies]\nt = 1\n'
    df = spark.createDataFrame([(str(i), p, text) for i, p in enumerate(paths)], "repo string, p string, content string") \
        .select("repo", F.when(F.length("repo") > 0, F.concat(F.lit("app/"), "p")).alias("path"), "content")
    got = manifests.extract_all(df)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("package.json") == 1
    assert sorted(tuple(r) for r in got.collect()) == [("0", "t", False), ("2", "k", False)]


def test_blocks_of_toml(spark):
    """blocks end where they did, and are read without a look ahead at each character."""
    old = r"(?m)^\[(?:build-)?dependencies(?:\.[^\]]+)?\]((?s:.*?))(?=^\[|\Z)"
    pieces = ["[dependencies]", "[build-dependencies.x]", "[dev-dependencies]", "[", "]", "\n", "\n", "a = 1", " b.c", "\r\n", "[[x]]", "é"]
    rng = random.Random(4)
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(14))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts + ["[dependencies]\n" + "a = 1\n" * 100_000]], "t string")
    got = df.select("t", manifests.every(F.col("t"), manifests.TOML_PROD_BLOCK).alias("b")).collect()
    for row in got[:-1]:
        assert [b.rstrip("\n") for b in row.b] == [b.rstrip("\n") for b in re.findall(old, row.t)]
    assert len(got[-1].b) == 1 and got[-1].b[0].count("a") == 100_000
    assert ".*?" not in manifests.TOML_PROD_BLOCK + manifests.TOML_DEV_BLOCK
