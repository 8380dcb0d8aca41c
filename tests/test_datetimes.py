"""Formats of times in text columns."""

import datetime as dt

from slotwise.sources import datetimes as tm
from slotwise.sources import tables as tb

T = dt.datetime


def inferred(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    out = tm.infer_formats(df)
    return dict(out.dtypes)["x"], [r.x for r in out.collect()]


GOOD = [
    ("2023-01-05", T(2023, 1, 5)), ("2023/1/5 3:04", T(2023, 1, 5, 3, 4)), ("2023.01.05T03:04:05.25", T(2023, 1, 5, 3, 4, 5, 250000)),
    ("20230105", T(2023, 1, 5)), ("2023-01-05T03:04:05Z", T(2023, 1, 5, 3, 4, 5)), ("2023-01-05 03:04:05+02:00", T(2023, 1, 5, 1, 4, 5)),
    ("2023-01-05 23:04 -0530", T(2023, 1, 6, 4, 34)), ("2023-01-05 03:04 UTC", T(2023, 1, 5, 3, 4)), ("2023-01-05 00:30 +01", T(2023, 1, 4, 23, 30)),
    ("5 Jan 2023", T(2023, 1, 5)), ("05-JAN-2023 12:00 am", T(2023, 1, 5)), ("January 5, 2023 12:15 PM", T(2023, 1, 5, 12, 15)),
    ("Thu, 5 Jan 2023 03:04:05 GMT", T(2023, 1, 5, 3, 4, 5)), ("Thursday Jan. 5th, 2023", T(2023, 1, 5)), ("Sept 30 2023", T(2023, 9, 30)),
    ("2023-Feb-05", T(2023, 2, 5)), ("1/5/2023", T(2023, 1, 5)), ("13/5/2023", T(2023, 5, 13)), ("5.13.23 1:02:03 p.m.", T(2023, 5, 13, 13, 2, 3)),
    ("1/5/69", T(1969, 1, 5)), ("29 February 2024", T(2024, 2, 29)), ("2023-01-05 03:04:05,123456789", T(2023, 1, 5, 3, 4, 5, 123457)),
]
BAD = [
    "2023-13-05", "2023-02-29", "2023-01-05 24:00", "2023-01-05 3", "2023-01-05 13:00 pm", "2023-01-05 0:10 am", "2023-01-05 10:60",
    "2023-01-05 10:10:60", "5 Foo 2023", "32/1/2023", "13/13/2023", "2023-01/05", "12:30", "tomorrow", "2023-01-05 10:00 +25:00", "1",
    "2023-01-05Z", "12345678901", "Janu 5, 2023",
]


def many(spark, columns):
    """One column per list of values: types and values after inference, in one pass."""
    rows = list(zip(*columns))
    out = tm.infer_formats(spark.createDataFrame(rows, ", ".join(f"c{i} string" for i in range(len(columns)))))
    return [t for _, t in out.dtypes], list(zip(*out.collect()))


def test_one_format(spark):
    for i in range(0, len(GOOD), 8):
        types, values = many(spark, [[text, None, "  "] for text, _ in GOOD[i:i + 8]])
        for (text, want), kind, own in zip(GOOD[i:i + 8], types, values):
            assert (kind, own) == ("timestamp_ntz", (want, None, None)), text


def test_no_time(spark):
    for i in range(0, len(BAD), 8):
        types, _ = many(spark, [["2023-01-05", text] for text in BAD[i:i + 8]])
        assert types == ["string"] * len(types), list(zip(BAD[i:i + 8], types))


def test_one_reading_per_column(spark):
    assert inferred(spark, ["3/4/2023", "5/6/2023"])[1] == [T(2023, 3, 4), T(2023, 5, 6)]
    assert inferred(spark, ["3/4/2023", "25/6/2023"])[1] == [T(2023, 4, 3), T(2023, 6, 25)]
    assert inferred(spark, ["3/25/2023", "25/6/2023"])[0] == "string"
    assert inferred(spark, ["3/4/2023", "5 June 2023", "2023-07-08 09:10+01:00"])[1] == [T(2023, 3, 4), T(2023, 6, 5), T(2023, 7, 8, 8, 10)]


def test_columns_without_values_and_other_types_stay(spark):
    df = spark.createDataFrame([(None, "", 5, "2023-01-01")], "a string, b string, n int, `odd name` string")
    assert dict(tm.infer_formats(df).dtypes) == {"a": "string", "b": "string", "n": "int", "odd name": "timestamp_ntz"}
    assert tm.infer_formats(df.select("n")).dtypes == [("n", "int")]
    assert tm.infer_formats(df.limit(0)).dtypes == df.dtypes


def test_a_csv_is_read_with_its_formats(spark, tmp_path):
    df = spark.createDataFrame([("31/01/2023 10:00", "x", "Jan 5, 2023"), ("01/02/2023 11:30", "2023-01-01", None)], "a string, b string, c string")
    path = str(tmp_path / "csv")
    df.write.options(header=True, compression="gzip", **tb.CSV_OPTIONS).csv(path)
    rows = sorted(tuple(r) for r in tb.read_csv_gzip(spark, path, partitions=1).collect())
    assert rows == [(T(2023, 1, 31, 10), "x", T(2023, 1, 5)), (T(2023, 2, 1, 11, 30), "2023-01-01", None)]


def test_a_text_is_searched_twice_only(spark):
    df = spark.createDataFrame([("31/01/2023 10:00", "5 Jan 2023")], "a string, b string")
    plan = tm.infer_formats(df)._jdf.queryExecution().executedPlan().toString().lower()
    # White space, then the one pattern; no order of a date is tried by itself.
    assert plan.count("regexp_replace(") == 4 and "rlike" not in plan and "regexp_extract" not in plan


def test_impossible_times_and_odd_texts(spark):
    bad = ["29 Feb 1900", "31/4/2023", "2023-01-05 10:00:59.9999996", "2023-01-05 10:00 -24:00", "|||", "0|1", "mon", "00/10/2023", "2023-01-05 0:00 pm"]
    types, _ = many(spark, [["2023-01-05", text] for text in bad])
    assert types == ["string"] * len(bad)
    good = [("29 Feb 2000", T(2000, 2, 29)), ("2023-01-05 10:00:59.9999994", T(2023, 1, 5, 10, 0, 59, 999999)), ("Mon,  5\tjan 2023", T(2023, 1, 5)),
            ("2023-01-05 00:10 -2359", T(2023, 1, 6, 0, 9)), ("31/12/70t1:02", T(1970, 12, 31, 1, 2)), ("2/3/04 12 : 00", None)]
    types, values = many(spark, [[text] for text, _ in good])
    for (text, want), kind, own in zip(good, types, values):
        assert (kind, own) == (("timestamp_ntz", (want,)) if want else ("string", (text,))), text
