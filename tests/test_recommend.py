import numpy as np
import pyarrow as pa
import pytest

from lattica.operators import recommend, users


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(3)
    items = [(i, rng.normal(size=4).tolist(), ["AV", "GAME", "WEBNOVEL"][i % 3]) for i in range(30)]
    people = [(u, rng.normal(size=4).tolist()) for u in range(5)]
    return items, people, spark.createDataFrame([x[:2] for x in items], "content_id long, vector array<double>"), spark.createDataFrame(people, "user_id long, vector array<double>")


def ranked(items, v):
    unit = lambda x: np.asarray(x) / (np.linalg.norm(x) + 1e-12)
    return sorted(((-round(float(unit(v) @ unit(x)), 9), i, d) for i, x, d in items))


@pytest.mark.parametrize("block", [50_000, 7])
def test_topk(world, monkeypatch, block):
    items, people, i, u = world
    monkeypatch.setattr(recommend, "BLOCK_ROWS", block)
    got = {(r["user_id"], r["rank"]): r["content_id"] for r in recommend.topk_cosine(u, i, 4).collect()}
    assert got == {(n, k + 1): x[1] for n, v in people for k, x in enumerate(ranked(items, v)[:4])}


@pytest.mark.parametrize("spread,most", [(0.15, 0.35), (0.6, 1.0), (50.0, 1.0)])
def test_pruned_scoring_is_exact(spark, monkeypatch, spread, most):
    """Clustered and shapeless items, ties, equal items beyond a block, vectors of length 0, domains with few items."""
    monkeypatch.setattr(recommend, "BLOCK_ROWS", 20)
    rng = np.random.default_rng(11)
    centres = rng.normal(0, 1, (12, 8))
    vectors = centres[rng.integers(0, 12, 400)] + rng.normal(0, spread, (400, 8))
    vectors[50:110], vectors[200:203] = vectors[50], 0.0
    domains = [["AV", "GAME", "WEBNOVEL", "OTHER", None][(n % 7) % 5] if n % 97 else "RARE" for n in range(400)]
    people = np.concatenate((centres[rng.integers(0, 12, 60)] + rng.normal(0, spread, (60, 8)), vectors[50:52], np.zeros((1, 8))))
    i = spark.createDataFrame([(n, v.tolist(), d) for n, (v, d) in enumerate(zip(vectors, domains))], "content_id long, vector array<double>, domain string")
    u = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(people)], "user_id long, vector array<double>")
    unit = lambda m: m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-12)
    scores = np.round(unit(people) @ unit(vectors).T, 9)
    for quota in (None, {"AV": 3, "GAME": 2, "RARE": 9}):
        counted: list[int] = []
        got = {}
        for r in recommend.best_items(u, i, 5, quota, counted=counted).collect():
            assert got.setdefault(r["user_id"], {}).setdefault(r["content_id"], r["score"]) == r["score"] and r["domain"] == domains[r["content_id"]]
        for n in range(len(people)):
            order = sorted(range(400), key=lambda j: (-scores[n, j], j))
            want = set(order[:5])
            for d, k in (quota or {}).items():
                want |= set([j for j in order if domains[j] == d][:k])
            assert want <= got[n].keys() and all(abs(got[n][j] - scores[n, j]) < 2e-9 for j in want)
        assert counted[-1] == 63 * 400 and sum(counted[:-1]) <= most * counted[-1] * (1 if quota is None else 1.6)


def test_a_task_has_few_bounds_and_scores_in_memory():
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000))], names=["user_id"])
    for width in (0, 7, 4_096, 10**7):
        parts = list(recommend.sliced(iter([batch, batch]), width))
        assert max(p.num_rows for p in parts) * width <= max(width, recommend.CELLS)
        assert [x for p in parts for x in p["user_id"].to_pylist()] == [*range(10_000)] * 2


def test_best_places_take_the_smaller_column_of_ties():
    s = np.random.default_rng(5).integers(0, 4, (9, 30)).astype(float)
    s[4], s[5, 2:] = 1.0, np.nan
    for idx, n in ((np.arange(30), 5), (np.array([1, 2, 3, 9, 20]), 3), (np.array([4, 8]), 3), (np.array([], int), 2)):
        want = {(u, j) for u in range(9) if u != 5 for j in sorted(idx.tolist(), key=lambda j: (-s[u, j], j))[:n]}
        assert {p for p in map(tuple, np.stack(np.divmod(recommend.best_places(s, idx, n), 30), 1).tolist()) if p[0] != 5} == want


def test_vectors_need_one_length():
    assert recommend.matrix_of(pa.chunked_array([[[1.0, None]], [[3.0, 4.0]]])).shape == (2, 2)
    for bad in ([[1.0], [1.0, 2.0, 3.0]], [[1.0, 2.0], None]):
        with pytest.raises(ValueError):
            recommend.matrix_of(pa.array(bad, pa.list_(pa.float64())))


def test_no_items_no_picks(spark, world):
    *_, i, u = world
    assert recommend.topk_cosine(u, i.limit(0)).count() == 0 and recommend.topk_cosine(u.limit(0), i).count() == 0


def test_quota_and_backfill(spark, world):
    items, people, i, u = world
    titles = [(n, d, None if d == "AV" and n > 3 else " " if n == 1 else f"t{n}") for n, _, d in items]
    contents = spark.createDataFrame(titles, "content_id long, domain string, title string")
    quota = {"AV": 3, "GAME": 2, "WEBNOVEL": 1}
    own = [x for x, t in zip(items, titles) if t[2] and t[2].strip()]
    for fill in (True, False):
        got = {}
        for r in recommend.domain_quota(u, i, contents, quota, fill).orderBy("user_id", "rank").collect():
            got.setdefault(r["user_id"], []).append(r["content_id"])
        for n, v in people:
            order = ranked(own, v)
            picked = [x for d, k in quota.items() for x in [y for y in order if y[2] == d][:k]]
            if fill:
                picked += [x for x in order if x not in picked][: sum(quota.values()) - len(picked)]
            assert got[n] == [x[1] for x in sorted(picked)]


def test_user_embeddings_skip_and_fall_back(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "content_id long, vector array<double>")
    genres = spark.createDataFrame([(1, "s", "Action"), (2, "s", "Drama")], "content_id long, source string, raw_genre string")
    prefs = spark.createDataFrame([(1, " ACTION "), (1, "drama"), (2, "unknown")], "user_id long, genre string")
    got = {r["user_id"]: r["vector"] for r in users.user_embeddings(items, genres, prefs, 2).collect()}
    assert set(got) == {1} and got[1] == pytest.approx([0.5**0.5] * 2)
    base = spark.createDataFrame([(1, "ann"), (2, None), (3, "nan")], "id long, username string")
    contents = spark.createDataFrame([(1, "AV"), (2, "GAME")], "content_id long, domain string")
    types = spark.createDataFrame([(1, "Movie"), (3, "GAME")], "preference_id long, content_type string")
    own = spark.createDataFrame([(1, "Drama"), (1, "Drama")], "preference_id long, genre string")
    b = {r["user_id"]: r for r in users.user_embeddings_blended(items, contents, genres, base, types, own, 2).collect()}
    assert b[1]["vector"] == pytest.approx((np.array([0.6, 0.4]) / np.hypot(0.6, 0.4)).tolist())
    assert b[2]["vector"] == pytest.approx([0.5**0.5] * 2) and b[3]["vector"] == pytest.approx([0, 1]) and b[3]["username"] == ""


def test_preference_ids(spark):
    genres = spark.createDataFrame([(1, "s", "Action")], "content_id long, source string, raw_genre string")
    by_name = spark.createDataFrame([("bob", "a"), ("ann", "b"), ("nan", "c")], "username string, genre string")
    assert {tuple(r) for r in users.user_genres(by_name).collect()} == {(1, "ann", "b"), (2, "bob", "a")}
    by_content = spark.createDataFrame([("7", "1"), ("8", "5")], "userid string, content_id string")
    assert {tuple(r) for r in users.user_genres(by_content, genres).collect()} == {(7, "", "action")}
    with pytest.raises(ValueError):
        users.user_genres(by_name.select("genre"))


def test_recent(spark):
    df = spark.createDataFrame([(1, "2021-01-01T00:00:00"), (2, "2019-12-31"), (3, "junk"), (4, None)], "content_id long, created_at string")
    assert [r[0] for r in recommend.recent_ids(df).collect()] == [1]
    assert recommend.recent_ids(df.drop("created_at")) is None


def test_genre_recommendations(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8])], "content_id long, vector array<double>")
    genres = spark.createDataFrame([("1", "s", "Action"), ("2", "s", "Drama"), ("2", "t", "Crime"), (None, "s", "x")], "content_id string, source string, raw_genre string")
    contents = spark.createDataFrame([("1", "AV", "one"), ("3", "GAME", "three")], "content_id string, domain string, title string")
    prefs = spark.createDataFrame([(7, "zoe", "action", 2), (7, "ann", "drama", 1), (7, "nan", "crime", 3), (8, None, "none known", 1)], "user_id long, username string, genre string, o int")
    got = [tuple(r) for r in recommend.genre_recommendations(items, genres, prefs, contents, 2, 2, order="o").orderBy("user_id", "rank").collect()]
    half = round(0.5**0.5, 9)
    assert [g[:7] for g in got] == [(7, "ann", 1, 2, None, None, "Crime|Drama"), (7, "ann", 2, 1, "one", "AV", "Action"), (8, "", 1, 1, "one", "AV", "Action"), (8, "", 2, 2, None, None, "Crime|Drama")]
    assert got[2][7] == pytest.approx(half) and got[3][7] == pytest.approx(half)
    with pytest.raises(ValueError):
        recommend.genre_topk(items, genres, prefs, 2, allowed=spark.createDataFrame([(9,)], "content_id long"))


def test_repeated_contents_keep_an_ordered_row(spark):
    """The first row names a recommendation, the last titled one gives a quota's domain and title."""
    rows = [(1, "z", "GAME", 2), (1, "a", "AV", 3), (1, "m", "WEBNOVEL", 1), (1, " ", "AV", 4)]
    contents = spark.createDataFrame(rows, "content_id long, master_title string, domain string, o int")
    recs = spark.createDataFrame([(7, 1)], "user_id long, content_id long")
    r = recommend.with_meta(recs, contents, contents_order="o").first()
    assert (r["master_title"], r["domain"]) == ("m", "WEBNOVEL")
    t = recommend.titled(contents, "o").first()
    assert (t["content_title"], t["domain"]) == ("a", "AV")
