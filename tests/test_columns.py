import pytest
from pyspark.sql import functions as F

from graphmill.functions import columns as C


def values(spark, rows, make):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(make).collect()]


def test_ascii_case_and_wildcards(spark):
    assert values(spark, ["ÀBc_%", None], C.ascii_lower("x")) == ["Àbc_%", None]
    assert values(spark, ["A_B", "AxB", "a_bc"], C.name_matches("x", "a_b", "prefix")) == [True, False, True]
    assert values(spark, ["50%", "505"], C.name_matches("x", "%", "contains")) == [True, False]


def test_utf16(spark):
    assert values(spark, ["a😀b", "", "é"], C.utf16_length("x")) == [4, 0, 1]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("const Foo *", "Foo"), ("struct ns::Bar&", "Bar"), ("&'a mut Baz", "Baz"), ("&mut Q", "Q"), ("List<Foo>", "List"), ("a.b.C?", "C"), ("void (*)(int)", ""), ("T[]", "T"), ("", "")],
)
def test_bare_type(spark, raw, want):
    assert values(spark, [raw], C.bare_type("x")) == [want]


def test_member_names_and_return_types(spark):
    assert values(spark, ["db.prepare", "db\n  .run", "plain", "x."], C.member_name("x")) == ["prepare", "run", "plain", "x."]
    assert values(spark, ["f(a): int", "\n fn f() -> T {", "x: y", "none", None], C.return_type("x"))[:1] == ["int"]
    assert values(spark, ["x: y", "none"], C.return_type("x")) == ["y", None]


def test_paths(spark):
    p = ["a/b/c.py", "c.py", "/x/y/z/w.py"]
    assert values(spark, p, C.directory_prefix("x", 2)) == ["a/b", ".", "/x"]
    assert values(spark, p, C.leading_segments("x", 2)) == ["a/b", "c.py", "/x"]
    assert values(spark, ["a/{b => c}/d", "a => b", "p", "a/{ => c}/d"], C.rename_paths("x")) == [["a/b/d", "a/c/d"], ["a", "b"], ["p"], ["a/d", "a/c/d"]]
    assert values(spark, ["src/a.py", "other/a.py"], C.in_scope("x", F.lit("src"))) == [True, False]


def test_weeks_match_the_calendar(spark):
    import datetime as dt

    days = [dt.datetime(2019, 12, 25, tzinfo=dt.UTC) + dt.timedelta(days=i) for i in range(800)]
    df = spark.createDataFrame([(int(d.timestamp()),) for d in days], "t long")
    got = df.orderBy("t").select(C.monday_week("t"), C.sunday_weekday("t")).collect()
    assert [tuple(r) for r in got] == [(d.strftime("%Y-W%W"), int(d.strftime("%w"))) for d in days]


def test_dates():
    assert C.iso_seconds("1970-01-02") == 86400
    assert C.iso_seconds("1970-01-01", end_of_day=True) == 86399
    assert C.iso_seconds("1970-01-01T00:00:10") == 10
    assert C.iso_seconds("soon") is None and C.iso_seconds(None) is None


def test_globs(spark):
    p = ["src/a.ts", "src/x/b.ts", "src/a.js", "lib/a.ts"]
    assert values(spark, p, C.selected("x", ["src/**/*.{ts,tsx}"])) == [True, True, False, False]
    assert values(spark, p, C.selected("x", ["src/*"], ["**/*.js"])) == [True, False, False, False]


def test_message_prefix_keeps_the_colon(spark):
    assert values(spark, ["Fix: x", "no prefix"], C.message_prefix("x")) == ["fix:", "(other)"]


def test_structural_text_and_lines(spark):
    df = spark.createDataFrame([(" a ", "a", None, "b")], "w string, x string, y string, z string")
    assert df.select(C.structural_text("w", "x", "y", "z")).first()[0] == "a\nb"
    assert values(spark, ["1\n2\n3"], C.line_slice("x", 2, 9)) == ["2\n3"]
    assert values(spark, ["a\r\nbb\rccc\n"], C.line_lengths("x")) == [[1, 2, 3, 0]]
