import json

import pytest
from pyspark.sql import functions as F

from laneweave.functions.text import json_kind
from laneweave.operators import validate
from laneweave.sources import osm, schemas

WAY = {"type": "way", "id": 1, "tags": {"highway": "path"}, "geometry": [{"lat": 1, "lon": 2}]}


def test_one_json_value_from_end_to_end(spark):
    want = {
        "{}": "object", ' \n{"a":[1,{"b":null}]}\t\r': "object", "[]": "array", "[1] ": "array", '"x"': "string", "1.5": "number", "-0": "number", "true": "boolean", "null": "null",
        "": None, " ": None, "{} {}": None, "{},{}": None, "[1] [2]": None, "[1],[2]": None, "1],[2": None, "{}] x [": None, '{}} x {"y":1': None, "{} trailing": None, "{broken": None, "{'a':1}": None, "nope": None, "1 2": None, '{"a":1,}': None,
    }
    got = {r.t: r.k for r in spark.createDataFrame([(t,) for t in want], "t string").select("t", json_kind(F.col("t")).alias("k")).collect()}
    assert got == want


def test_strict_reading(spark):
    bodies = {
        1: json.dumps({"elements": [WAY], "remark": ""}), 2: json.dumps({"elements": [WAY]}) + " trailing", 3: "[1]", 4: "null", 5: '{"remark":"late","elements":[]}', 6: None, 7: "", 8: '{"elements":{}}',
        9: json.dumps({"elements": [{**WAY, "id": "x"}, WAY, 7, None, {"type": "way"}, {**WAY, "id": 1.5}, {**WAY, "type": 3}, {"type": "node", "id": 8}]}), 10: '{"elements":[]}{"elements":[]}', 11: '{"remark":false,"elements":[]}', 12: '{"remark":{"why":"x"}}',
    }
    ok, bad = osm.parse_responses(spark.createDataFrame([(k, v, 5) for k, v in bodies.items()], "k int, value string, reason_code int"))
    assert ok.columns == ["k", "reason_code", "element_seq", "type", "id", "tags", "geometry"]
    assert sorted((r.k, r.element_seq, r.id, r.tags) for r in ok.collect()) == [(1, 0, 1, {"highway": "path"}), (9, 1, 1, {"highway": "path"}), (9, 7, 8, None)]
    rows = bad.collect()
    assert sorted((r.k, r.reason) for r in rows if r.element_seq is None) == [(2, "BAD_JSON"), (3, "NOT_OBJECT"), (4, "NOT_OBJECT"), (5, "REMARK"), (6, "BAD_JSON"), (7, "BAD_JSON"), (10, "BAD_JSON"), (12, "REMARK")]
    assert sorted((r.element_seq, r.reason, r.value) for r in rows if r.k == 9) == [(i, "BAD_ELEMENT", None) for i in (0, 2, 3, 4, 5, 6)]
    assert {r.k: r.remark for r in rows if r.reason == "REMARK"} == {5: "late", 12: '{"why":"x"}'} and all(r.value is not None for r in rows if r.k in (2, 3))
    empty = spark.createDataFrame([], "k int, value string")
    assert [d.count() for d in osm.parse_responses(empty)] == [0, 0]


@pytest.mark.parametrize("counts,good", [("{}", True), ("1", True), ('"0"', True), ("[]", True), ("0", False), ("0.0", False), ("-0", False), ('""', False), ("false", False), ("null", False)])
def test_counts_hold_something(spark, counts, good):
    data = f'{{"counts":{counts},"roads":[],"buildings":[],"openLand":[]}}'
    rows = [(1, (1.0, 0.0, 1.0, 0.0), data, "[]"), (2, (1.0, 0.0, 1.0, 0.0), data, "[1] [2]"), (3, (1.0, 0.0, 1.0, 0.0), data + " {}", "[]")]
    df = spark.createDataFrame(rows, f"seq int, bbox {schemas.BBOX}, osm_data string, user_edits string")
    got = [r.reject_reason for r in validate.analyze_reject_reason(df).orderBy("seq").collect()]
    assert got == ([None, "BAD_EDITS", "NO_OSM_DATA"] if good else ["NO_OSM_DATA"] * 3)
    saves = df.withColumns({"name": F.lit("n"), "id": F.lit(""), "user_id": F.lit("u")})
    assert [r.reject_reason for r in validate.save_reject_reason(saves).orderBy("seq").collect()] == [None, "BAD_EDITS", "NO_OSM_DATA"]
