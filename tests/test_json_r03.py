"""Manifests in JSON."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lodestone.operators import manifests


def test_strict_json_is_read_once(spark):
    """strict JSON is read as a variant; other texts as before."""
    npm = ['{"dependencies":{"b":"1","a":null},"devDependencies":{"z":{"q":1}}}', '[{"dependencies":{"b":"1"}}]',
           '{"dependencies":{"b":"1"},"dependencies":{"c":"1"}}', '{"dependencies":["x"],"devDependencies":{"k":1}}',
           "{'dependencies':{'b':'1'}}", '{"dependencies":{"b":"1"} junk', "", None, "{}"]
    df = spark.createDataFrame([(x,) for x in npm], "t string")
    names = df.select("t", manifests.npm_names(F.col("t")).alias("n"))
    assert "parse_json" in names._jdf.queryExecution().toString()
    parsed = F.from_json("t", manifests.NPM_SCHEMA)
    old = df.select("t", *[F.map_keys(parsed[f]).alias(f) for f in manifests.NPM_FIELDS])
    for new, was in zip(names.collect(), old.collect()):
        prod = {k for f in manifests.NPM_FIELDS[:3] for k in was[f] or []}
        assert set(new.n.prod) == prod and set(new.n.dev) == set(was[manifests.NPM_FIELDS[3]] or [])
    deps = [{"Deps": [{"ImportPath": "a/b/c/d"}, {"Rev": "2"}]}, {"Deps": [{"ImportPath": 5}, {"ImportPath": "q"}]}, {"Deps": "x"}]
    df = spark.createDataFrame([(json.dumps(x),) for x in deps], "t string")
    names = df.select(manifests.godeps_names(F.col("t")).alias("n"))
    assert "parse_json" in names._jdf.queryExecution().toString()
    assert [sorted(r.n.prod) for r in names.collect()] == [["a/b/c", "a/b/c/d"], ["5", "q"], []]
