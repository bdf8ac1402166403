import re

import pytest

from urbanloom.operators.records import parse_records, rejected, valid

GOOD_POINT = 'c1,12,1.5,2,3e1,2,10,1,2'
GOOD_FIELD = '77;Åsen;59.1;18.2;;-3.5;G;ok'
CASES = [
    ("points", GOOD_POINT, None),
    ("points", ' "c ""x"" , 1" ,\t12 ,1.5,2,+.5,,,,\r', None),
    ("points", '"c1,12,1.5,2,3,2,10,1,2', "quoting"),
    ("points", 'c"1,12,1.5,2,3,2,10,1,2', "quoting"),
    ("points", '"c1"x,12,1.5,2,3,2,10,1,2', "quoting"),
    ("points", '"a"b",1', "quoting"),
    ("points", "c1,12,1.5,2,3,2,10,1", "column_count"),
    ("points", "", "column_count"),
    ("points", None, "column_count"),
    ("points", "c1,12,nan,2,3,2,10,1,2", "invalid_value"),
    ("points", "c1,12,1e999,2,3,2,10,1,2", "invalid_value"),
    ("points", "c1,-12,1,2,3,2,10,1,2", "invalid_value"),
    ("points", ",12,1,2,3,2,10,1,2", "invalid_value"),
    ("points", "c1,12,1,2,3,256,10,1,2", "invalid_value"),
    ("points", "c1,12,1,2,3,2,10,0,2", "invalid_value"),
    ("points", "c1,12,１,2,3,2,10,1,2", "invalid_value"),
    ("points", "c1,99999999999999999999999,1,2,3,2,10,1,2", None),
    ("fields", GOOD_FIELD, None),
    ("fields", '77;"A; B";59.1;18.2;;;;', None),
    ("fields", "77;A;90.1;18.2;;;;", "invalid_value"),
    ("fields", "77;A;59;181;;;;", "invalid_value"),
    ("fields", "77;A;59;18;;;X;", "invalid_value"),
    ("fields", "77;A;59;18;x;;G;", "invalid_value"),
    ("fields", "77;A;59;18;;;G", "column_count"),
    ("fields", 'a\rb;A;59;18;;;G;', "invalid_value"),
    ("other", "x", "unknown_layout"),
    (None, "x", "unknown_layout"),
    ("points", "c1," + "9" * 200_000 + ",1,2,3,2,10,1,2", None),
]


def test_cases_and_extra_columns(spark):
    rows = [(k, layout, line, "r", "x") for k, (layout, line, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "record_id bigint, layout string, line string, reason string, points string")
    parsed = parse_records(df)
    got = {r.record_id: r.reason for r in parsed.collect()}
    assert got == {k: why for k, (_, _, why) in enumerate(CASES)}
    assert {r.record_id for r in rejected(parsed).collect()} == {k for k, c in enumerate(CASES) if c[2]}


def test_typed_values(spark):
    df = spark.createDataFrame([(1, "points", CASES[1][1]), (2, "fields", GOOD_FIELD)], "record_id bigint, layout string, line string")
    parsed = parse_records(df)
    p = valid(parsed, "points").first()
    assert (p.cloud_id, p.point_id, p.x, p.z, p.classification) == ('c "x" , 1', 12, 1.5, 0.5, None)
    f = valid(parsed, "fields").first()
    assert (f.station_id, f.station_name, f.lat, f.height, f.value, f.quality, f.comment) == ("77", "Åsen", 59.1, None, -3.5, "G", "ok")


def test_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "points", "x")] * 3, "record_id bigint, layout string, line string")
    assert parse_records(df).count() == 3
    assert parse_records(df.limit(0)).count() == 0


def _split(line: str, delimiter: str):
    out, i = [], 0
    while True:
        j = i
        while j < len(line) and line[j] in " \t\r":
            j += 1
        if j < len(line) and line[j] == '"':
            k, text = j + 1, ""
            while True:
                if k >= len(line):
                    return None
                if line[k] == '"':
                    if line[k + 1 : k + 2] == '"':
                        text, k = text + '"', k + 2
                        continue
                    break
                text, k = text + line[k], k + 1
            k += 1
            while k < len(line) and line[k] in " \t\r":
                k += 1
            if k < len(line) and line[k] != delimiter:
                return None
            out.append(text.strip(" \t\r"))
        else:
            k = line.find(delimiter, i)
            k = len(line) if k < 0 else k
            if '"' in line[i:k]:
                return None
            out.append(line[i:k].strip(" \t\r"))
        if k >= len(line):
            return out
        i = k + 1


@pytest.mark.parametrize("alphabet", ['a", ', '";\t\r1', '"",,a'])
def test_structure_against_a_scanner(spark, alphabet):
    import random

    pick = random.Random(5)
    lines = ["".join(pick.choice(alphabet) for _ in range(pick.randint(0, 14))) for _ in range(1500)]
    layout, d, n = ("fields", ";", 8) if ";" in alphabet else ("points", ",", 9)
    df = spark.createDataFrame([(k, layout, x) for k, x in enumerate(lines)], "record_id bigint, layout string, line string")
    for r in parse_records(df).collect():
        f = _split(lines[r.record_id], d)
        want = "quoting" if f is None else "column_count" if len(f) != n else None
        assert r.reason == want or (want is None and r.reason == "invalid_value"), lines[r.record_id]


def test_number_pattern():
    from urbanloom.operators.records import NUMBER

    assert all(re.match(NUMBER, s) for s in ("1", "+1.", "-.5", "1e5", "1.5E-3"))
    assert not any(re.match(NUMBER, s) for s in ("", ".", "1e", "e5", "0x1", "1_0", "inf", "1,5"))


def test_keys_of_nineteen_digits(spark):
    keys = {"1000000000000000000": 10**18, "0009223372036854775807": 2**63 - 1, "9223372036854775808": None, "10000000000000000000": None, "999999999999999999": 10**18 - 1}
    df = spark.createDataFrame([(k, "points", f"c1,{text},1,2,3,2,10,1,2") for k, text in enumerate(keys)], "record_id bigint, layout string, line string")
    assert [r.point_id for r in valid(parse_records(df), "points").orderBy("record_id").collect()] == list(keys.values())
