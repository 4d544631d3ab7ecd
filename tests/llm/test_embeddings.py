"""Clustering, whitening and exact dedup against brute-force versions, and their edge cases."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import _base as B
from lattica.llm import chunks, clusters, queries, whitening

DIR = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, x string, norms string, cluster string, id string, w int, n int"
BIG = [2**53 + 1, 2**63 - 1, -(2**63), None]


def table(spark, rows):
    """rows: (vec_id, vector); further columns have names that clash with those used inside."""
    return spark.createDataFrame([(i, v, 1, "a", "b", "c", "d", 2, 3) for i, v in rows], VECTORS)


def noise(seed, n, dims=64, spread=0.2):
    rng = np.random.default_rng(seed)
    return (rng.normal(0, spread, (n, dims)) + rng.normal(0, 1, (3, dims))[rng.integers(0, 3, n)] * 0.3).astype(np.float32)


ODD_VECTORS = [(900, None), (901, []), (902, [0.5] * 63), (903, [0.5] * 65), (904, [None] + [0.5] * 63), (905, [float("nan")] + [0.5] * 63), (906, [float("inf")] + [0.5] * 63)]


# -- op11 ----------------------------------------------------------------------------------------


def plain_clusters(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(c)) for c in v]) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cents = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        member = defaultdict(list)
        for _, v in kept:
            member[near(v)[1]].append(v)
        cents = [[sum(col) // len(member[j]) for col in zip(*member[j])] if member[j] else c for j, c in enumerate(cents)]
    found = [(i, *near(v)) for i, v in kept]
    inertia = defaultdict(int)
    for _, d, j in found:
        inertia[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), digest[j]) for i, d, j in found), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_against_plain_python(spark, seed):
    rows = [(i, v.tolist()) for i, v in enumerate(noise(seed, 120))] + ODD_VECTORS
    assert rows_of(clusters.cluster(table(spark, rows))) == plain_clusters(rows)


def test_cluster_edges(spark):
    assert clusters.cluster(table(spark, [])).collect() == [] and clusters.cluster(table(spark, ODD_VECTORS)).collect() == []
    few = [(i, v.tolist()) for i, v in enumerate(noise(3, 5))]
    assert rows_of(clusters.cluster(table(spark, few))) == plain_clusters(few)
    same = [(i % 3, [0.25] * 64) for i in range(9)] + [(None, [0.25] * 64)]  # ties, repeated rows: all go to the first centroid
    found = rows_of(clusters.cluster(table(spark, same)))
    assert found == plain_clusters(same) and {r[1] for r in found} == {0}
    ids = list(zip(BIG, noise(4, 4).tolist()))
    assert rows_of(clusters.cluster(table(spark, ids))) == plain_clusters(ids)
    with pytest.raises(Exception, match="too large"):
        clusters.cluster(table(spark, [(1, [1e30] * 64)])).collect()


def test_bounds_never_exceed_the_distance():
    rng = np.random.default_rng(5)
    for scale in (3, 500, 10**7):
        x, c = (np.floor(rng.normal(0, scale, (n, 64))).astype(np.int64) for n in (300, 8))
        x[0], c[0] = 0, 0
        codes, step, norms = clusters.compressed(x)
        exact = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        bounds = clusters.lower_bounds((x**2).sum(axis=1), codes, step, norms, c)
        assert (bounds <= exact).all()
        cluster, best, measured = clusters.nearest(x, bounds, c)
        assert (cluster == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all() and measured < 1.5 * len(x)


def test_most_distances_are_ruled_out(spark):
    x = clusters.quantised(spark.read.parquet(f"{DIR}/embeddings.parquet"), "vec_id", "embedding")
    found = clusters.gathered(x, clusters.fit(x, rounds=3))
    assert sum(r[3] for r in found) < 1.2 * sum(r[1] for r in found)


# -- op13 ----------------------------------------------------------------------------------------


def plain_whitening(vectors, most=32):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    c = np.array(n * x - sums, float) / n
    values, vecs = np.linalg.eigh(c.T @ c / n)
    values, vecs = values[::-1][:most], vecs[:, ::-1][:, :most]
    return ((n * x - sums) ** 2).sum(axis=1), c @ vecs / np.sqrt(values), values / np.trace(c.T @ c / n)


@pytest.mark.parametrize("n,dims,most", [(300, 64, 32), (200, 8, 32), (150, 16, 5)])
def test_whitening_against_numpy(spark, n, dims, most):
    vectors = noise(n, n, dims).tolist()
    odd = [(900, None), (901, []), (902, [0.5]), (904, [None] + [0.5] * (dims - 1)), (905, [float("nan")] + [0.5] * (dims - 1)), (906, [float("-inf")] + [0.5] * (dims - 1))]
    ids = [*range(n - 3), 2**53 + 1, 2**63 - 1, None]
    found = whitening.whiten(table(spark, list(zip(ids, vectors)) + odd), most).collect()
    deviation, whitened, explained = plain_whitening(vectors, most)
    k = min(dims, most)
    assert len(found) == n * k and {r["n"] for r in found} == {n}
    by = {(r["vec_id"], r["component"]): r for r in found}
    for j in range(k):
        own = [by[i, j + 1] for i in ids]
        assert [r["deviation"] for r in own] == deviation.tolist()
        got = np.array([r["whitened"] for r in own])
        assert min(np.abs(got - whitened[:, j]).max(), np.abs(got + whitened[:, j]).max()) < 1e-8
        assert own[0]["explained"] == pytest.approx(explained[j], rel=1e-9)
    (error,) = {r["identity_error"] for r in found}
    w = np.array([[by[i, j + 1]["whitened"] for j in range(k)] for i in ids])
    assert error < 1e-9 and np.abs(np.cov(w.T, bias=True) - np.eye(k)).max() < 1e-9


def test_whitening_edges(spark):
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, None), (2, [])], [(1, [0.5] * 4)], [(i, [0.5, 0.25]) for i in range(5)]):  # no rows, or nothing but equal vectors
        found = whitening.whiten(table(spark, rows))
        assert found.columns == columns and found.collect() == []
    line = whitening.whiten(table(spark, [(i, [float(i), 2.0 * i, -1.0 * i]) for i in range(6)] * 2)).collect()  # one direction, repeated rows
    assert len(line) == 12 and {r["component"] for r in line} == {1} and line[0]["explained"] == pytest.approx(1)
    mixed = whitening.whiten(table(spark, [(i, v) for i, v in enumerate(noise(6, 20, 3).tolist())] + [(99, [0.1] * 7)])).collect()
    assert {r["vec_id"] for r in mixed} == set(range(20))


def test_whitening_is_one_aggregation_of_pairs():
    assert whitening.upper_triangle(3) == ["sum(c0 * c0) AS p0_0", "sum(c0 * c1) AS p0_1", "sum(c0 * c2) AS p0_2", "sum(c1 * c1) AS p1_1", "sum(c1 * c2) AS p1_2", "sum(c2 * c2) AS p2_2"]
    assert len(whitening.upper_triangle(64)) == 2_080


def test_common_offset_costs_no_digits(spark):
    """Means of a million beside variances of one: centred sums lose nothing."""
    rng = np.random.default_rng(7)
    x = [(i, (rng.integers(-1, 2, 4) + 4_000_000).tolist()) for i in range(400)]
    m = whitening.moments(spark.createDataFrame(x, "id long, x array<long>").select(*(F.col("x")[k].alias(f"c{k}") for k in range(4))), 4, exact=True)
    assert np.abs(m.covariance - np.cov(np.array([v for _, v in x], float).T - 4_000_000, bias=True)).max() < 1e-14


# -- op12 ----------------------------------------------------------------------------------------

TEXTS = "doc_id long, text string, lang string, recipe string, key string, row string, sha int, n int, id int"


def texts(spark, rows):
    return spark.createDataFrame([(i, t, None, "r", "k", "w", 1, 2, 3) for i, t in rows], TEXTS)


def plain_groups(rows):
    own = defaultdict(list)
    for i, t in rows:
        own[t or ""].append(i)
    out = []
    for t, ids in own.items():
        keep = max((i for i in ids if i is not None), default=None)
        kept = [False] * (len(ids) - 1) + [True]
        rank = sorted(ids, key=lambda i: (i is not None, i or 0))
        out += [(i, keep, len(ids), k, hashlib.sha256(t.encode()).hexdigest()) for i, k in zip(rank, kept)]
    return sorted(out, key=repr)


def some_texts(seed, n=60):
    rng = random.Random(seed)
    words = [rng.choice("abcdefghij") * rng.randint(1, 9) for _ in range(40)]
    own = [" ".join(rng.choices(words, k=rng.choice([0, 1, 5, 50, 3_000, 20_000]))) for _ in range(n)]
    rows = [(i, rng.choice(own[: n // 2]) if rng.random() < 0.4 else t) for i, t in enumerate(own)]
    long = own[-1] + "x" * 200_000  # long stretches without a cut
    return rows + [(1_000, None), (1_001, ""), (1_002, "é日本 " * 900), (1_003, "é日本 " * 900), (1_004, long), (1_005, long), (1_006, long + "y"), (1_007, "y" + long)]


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_groups_against_plain_python(spark, seed):
    rows = some_texts(seed)
    found = chunks.exact_groups(texts(spark, rows)).drop("n_chunks")
    assert rows_of(found) == plain_groups(rows)


def test_exact_group_edges(spark):
    assert chunks.exact_groups(texts(spark, [])).collect() == []
    rows = [(2**53 + 1, "a b"), (2**53 + 3, "a b"), (None, "a b"), (7, "c"), (7, "c"), (None, None), (None, ""), (-(2**63), "d"), (2**63 - 1, "d")]
    assert rows_of(chunks.exact_groups(texts(spark, rows)).drop("n_chunks")) == plain_groups(rows)


def test_digests_that_two_chunks_share_are_found(spark, monkeypatch):
    """A digest of one byte names many chunks: verification rejects it, and the next one decides."""
    monkeypatch.setattr(chunks, "DIGESTS", (short_digest, chunks.digest_512))
    monkeypatch.setattr(B, "HOT_KEYS", 3)
    rows = [(i, f"text {i}") for i in range(300)] + [(1_000 + i, f"text {i % 7}") for i in range(100)]
    assert rows_of(chunks.exact_groups(texts(spark, rows)).drop("n_chunks")) == plain_groups(rows)
    monkeypatch.setattr(chunks, "DIGESTS", (short_digest,))
    with pytest.raises(ValueError, match="share a digest"):
        chunks.exact_groups(texts(spark, rows))


def short_digest(chunk):
    return hashlib.md5(chunk).digest()[:1]


def test_texts_are_rebuilt_from_recipes_and_chunks(spark):
    rows = some_texts(3)
    own = texts(spark, rows).select("doc_id", "text")
    store = {bytes(r["digest"]): bytes(r["chunk"]) for r in chunks.chunk_table(own).collect()}
    found = chunks.recipes(own).collect()
    assert len(found) == len(rows)
    for r in found:
        parts = [bytes(r["recipe"][k : k + 16]) for k in range(0, len(r["recipe"]), 16)]
        assert len(parts) == r["n_chunks"] and b"".join(store[p] for p in parts).decode() == (dict(rows)[r["doc_id"]] or "")
    assert sum(map(len, store.values())) < 0.8 * sum(len((t or "").encode()) for _, t in rows)


def test_chunks_are_cut_by_content():
    """Bytes put in at the front move the cuts with them, so that all but the first chunks stay."""
    data = np.random.default_rng(8).integers(97, 123, 400_000, dtype=np.uint8)
    own, moved = (chunks.chunked(x) for x in (data, np.concatenate((data[:777], data))))
    assert b"".join(own) == data.tobytes() and all(chunks.LEAST <= len(c) <= chunks.MOST for c in own[:-1])
    assert len(set(own) & set(moved)) >= len(own) - 3 and len(own) > 40


@pytest.mark.parametrize("name", ["op11_centroid_clusters", "op12_exact_dedup", "op13_whitening"])
def test_queries_read_the_tables(spark, name):
    found = queries.queries()[name](spark, DIR)
    counts = {"op11_centroid_clusters": 500, "op12_exact_dedup": 200, "op13_whitening": 500 * 32}
    assert found.count() == counts[name]
