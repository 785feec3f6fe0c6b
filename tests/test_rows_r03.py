"""Wide rows of payloads. Every test builds its own rows."""

from __future__ import annotations

import re

from lodestone.operators import project_row

SCHEMA = "repo_url string, kind string, payload string, header string, landed long"


def test_fields_that_fit_are_read_without_the_raw_value(spark):
    """a field's typed value is asked for first, and once more to be kept."""
    given = [("repo", '{"description": "d", "stargazers_count": 3, "fork": true, "topics": ["a"]}'),
             ("repo", '{"description": null, "stargazers_count": "many", "topics": "x", "size": "7"}'), ("repo", "["), ("repo", None),
             (None, '{"description": "d"}'), ("participation", '{"all": [1, 2], "owner": 5}'), ("languages", '{"Rust": 1, "Go": 2}'),
             ("languages", "[1]"), ("commits", '[{"sha": "a"}, 1]'), ("tags", "{}"), ("branches", "[]"),
             ("community", '{"health_percentage": "x", "files": {"contributing": {"url": "u"}, "code_of_conduct": null}}')]
    df = spark.createDataFrame([("u", k, p, None, i) for i, (k, p) in enumerate(given)], SCHEMA)
    typed = project_row.typed_payloads(df)
    shown = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        plan = typed._jdf.queryExecution().analyzed().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", shown)
    value = r"try_variant_get\(\S+, \$\.owner, ArrayType\(DoubleType"
    assert len(re.findall(value, plan)) == 2
    assert re.search(rf"isnull\({value}", plan).start() < re.search(r"\$\.owner, VariantType", plan).start()
    got = {r.landed: r for r in typed.collect()}
    read = {i: {k: v for k, v in r.read.asDict(recursive=True).items() if v is not None} for i, r in got.items()}
    wrong = {i: sorted((m.path, m.found) for m in r.misfits) for i, r in got.items() if r.misfits}
    assert wrong == {1: [("$.stargazers_count", '"many"'), ("$.topics", '"x"')], 2: [("$", "")], 5: [("$.owner", "5")], 7: [("$", "[1]")],
                     9: [("$", "{}")], 11: [("$.health_percentage", '"x"')]}
    assert read[0] == {"description": "d", "stars": 3, "is_fork": True, "topics": ["a"]}
    assert read[5] == {"all": [1.0, 2.0]} and read[8] == {"commits": 2} and read[10] == {"branches": 0} and read[9] == {}
    assert read[6] == {"languages": [{"key": "Go", "value": 2}, {"key": "Rust", "value": 1}]} and read[2] == read[3] == read[4] == {}
