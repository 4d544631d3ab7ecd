import pytest
from pyspark.sql import functions as F

from lattica.functions import columns as C
from lattica.functions import text as X
from lattica.functions import vectors as V


def values(spark, rows, expression, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(expression(F.col("x"))).collect()]


def test_bigint(spark):
    assert values(spark, ["2.0", "x", None, "1.5", " 7 ", "-3", "9007199254740993"], C.to_bigint) == [2, None, None, None, 7, -3, 9007199254740993]


def test_strip_takes_all_white_space(spark):
    assert values(spark, ["　a b \n", None], C.py_strip) == ["a b", None]
    assert values(spark, ["  ", "　", " a"], C.blank_to_null) == [None, None, "a"]


def test_norm_for_id(spark):
    assert values(spark, ["Science Fiction", "Sci-Fi & Fantasy_X é", "  ", None, "판타지/로맨스"], X.norm_for_id) == ["science_fiction", "sci_fi_fantasy_x_é", "", "", "판타지_로맨스"]


def test_genre_splits(spark):
    assert values(spark, ["드라마|범죄, A/B·C;D", "", None, " | "], X.parse_genres) == [["드라마", "범죄", "A", "B", "C", "D"], [], [], []]
    assert values(spark, ["a ; b;;c"], X.split_semicolon) == [["a", "b", "c"]]
    assert values(spark, ["a|b ; c/d,e"], X.split_multi) == [["a", "b", "c", "d", "e"]]


@pytest.mark.parametrize("first,rest,want", [("Drama", ["A", "B", "C"], ["Drama", "A", "B"]), ("B", ["A", "B", "C"], ["A", "B", "C"]), ("", ["A"], ["A"]), (None, ["A"], ["A"]), ("Z", [], ["Z"])])
def test_prepend_take(spark, first, rest, want):
    df = spark.createDataFrame([(first, rest)], "f string, r array<string>")
    assert df.select(X.prepend_take(F.col("f"), F.col("r"))).first()[0] == want


def test_dates(spark):
    assert values(spark, ["2025-10-29T01:02", "2020", None], X.date_prefix) == ["2025-10-29", "2020", ""]
    assert values(spark, ["2025-10-29", "", None], X.year_prefix) == ["2025", "", ""]
    assert values(spark, ["2021-03-04 05:06:07", "junk", None], X.iso_date) == ["2021-03-04", None, None]


def test_json_cells(spark):
    assert values(spark, ['"{""a"": 1}"', "[1, 2]", "{bad", "plain", None], X.parse_json_cell) == ['{"a":1}', "[1,2]", "{bad", "plain", None]
    assert values(spark, ['{"release_date":{"date":"d"}}', '{"release_date":"s"}', '{"release_date":null}', "{}"], X.polymorphic_date) == ["d", "s", "", ""]


def test_trim_value(spark):
    assert values(spark, ["a\nb", None, "x" * 201], X.trim_value) == ["a b", "", "x" * 200 + "..."]


def test_usernames(spark):
    assert values(spark, ["nan", " None ", "", None, "ann"], C.clean_username) == ["", "", "", "", "ann"]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 2.0], "a"), ([1.0, 0.0], None, "a"), ([0.0, 0.0], [1.0, 1.0], "b")], "u array<double>, v array<double>, k string")
    r = df.select(V.l2_normalize(F.col("u")), V.dot(F.col("u"), F.col("v")), V.cosine(F.col("u"), F.col("v")), V.blend(F.col("u"), F.col("v"), 0.5, 0.5)).collect()
    assert r[0][0] == pytest.approx([0.6, 0.8]) and r[0][1] == 8 and r[0][2] == pytest.approx(0.8) and r[0][3] == [1.5, 3.0]
    assert r[1][1] is None and r[1][3] == [1.0, 0.0]
    assert r[2][0] == [0.0, 0.0] and r[2][2] == 0
    for dim in (None, 2):
        m = {x["k"]: x["vector"] for x in V.mean_vector(df, ["k"], "u", dim).collect()}
        assert m == {"a": [2.0, 2.0], "b": [0.0, 0.0]}
    assert V.mean_vector(df.limit(0), [], "u", 2).count() == 0


def test_wide_vectors(spark):
    df = spark.createDataFrame([("1", "1", "2"), ("2", "x", "2")], "id string, EMB_0 string, emb_1 string")
    wide = V.wide_to_vector(df.withColumnRenamed("EMB_0", "emb_0"))
    assert [(r["id"], r["vector"]) for r in wide.collect()] == [("1", [1.0, 2.0])]
    assert V.vector_to_wide(wide, 2).columns == ["id", "emb_0", "emb_1"]
    with pytest.raises(ValueError):
        V.wide_to_vector(df.select("id"))


def test_resolve_column(spark):
    df = spark.createDataFrame([(1, 2)], "` Content_ID ` int, x int")
    assert C.resolve_column(df, C.CONTENT_ID) == " Content_ID "
    assert C.resolve_column(df, C.TITLE) is None
    with pytest.raises(ValueError):
        C.resolve_column(df, C.TITLE, required=True)
