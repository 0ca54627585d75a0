import json
import sqlite3

import pytest

from sylva.functions import json as J
from sylva.model import InvalidInput

DOCUMENTS = [
    '{"a":1}', '{"a":1.0}', '{"a":true}', '{"a":false}', '{"a":0}', '{"a":null}', '{"a":"1"}', '{"a":"true"}', '{"a":[1]}', '{"a":"[1]"}',
    '{"a":{"x":1,"y":2}}', '{"a":{"y":2,"x":1}}', '{"a":""}', '{"b":1}', '{"a":9007199254740993}', '{"a":9007199254740992}', '{"a":"ü"}', "{}",
    '{"a":1e30}', '{"a":1000000000000000000000000000000}', '{"a":1e-11}', '{"a":0.0}', '{"a":-0.0}', '{"a":9223372036854775807}',
    '{"a":9223372036854775808}', '{"a":-9223372036854775808}', '{"a":1.5e300}', '{"a":0.1}', '{"a":123456789012345678}', '{"a":1.2345678901234568e17}',
]
VALUES = [1, 1.0, True, False, 0, None, "1", "true", [1], "[1]", {"x": 1, "y": 2}, "", 9007199254740993, "ü", 2.5, 1e30, 10**30, 1e-11, 2**63, 2**63 - 1, -(2**63), 0.1, 1.5e300, 123456789012345678, 123456789012345680]


def test_equality_matches_sqlite(spark):
    df = spark.createDataFrame([(d,) for d in DOCUMENTS], "d string")
    con = sqlite3.connect(":memory:")
    for value in VALUES:
        got = {r.d for r in df.where(J.attribute_equals("d", "$.a", value)).collect()}
        want = {
            d for d in DOCUMENTS
            if con.execute("select json_extract(?, '$.a') = json_extract(?, '$')", (d, J.canonical(value))).fetchone()[0]
        }
        assert got == want, value


def test_broken_documents_match_nothing(spark):
    df = spark.createDataFrame([("{bad",), (None,), ("[1]",), ("3",)], "d string")
    assert df.where(J.attribute_equals("d", "$.a", 1)).count() == 0


def test_paths_have_columns_of_their_own():
    paths = ["$.a.b", "$.a__b", "$.a_.b", "$.a.b_", "$.A.b"]
    assert len({J.key_column(p).lower() for p in paths}) == len(paths)


@pytest.mark.parametrize("path", ["a", "$", "$.", "$.a..b", "$.a[0]", "$.a'b", "$.ä"])
def test_paths(path):
    with pytest.raises(InvalidInput):
        J.check_path(path)


def test_merge_patch_against_sqlite():
    con = sqlite3.connect(":memory:")
    for old, patch in [('{"a":1,"b":{"c":2,"d":3}}', '{"b":{"c":null,"e":4},"f":[1]}'), ('{"a":[1,2]}', '{"a":{"x":null}}'), ("{}", '{"z":null}')]:
        want = con.execute("select json_patch(?, ?)", (old, patch)).fetchone()[0]
        assert json.dumps(J.merge_patch(json.loads(old), json.loads(patch)), separators=(",", ":")) == want
