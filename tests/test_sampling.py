"""Negative samples: exact alias tables, draws that follow them, and pairs that are no edges."""

from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import relational, sampling


def exact_shares(rows):
    """Each token's part of all slots together, by the table."""
    size, share = len(rows), Counter()
    for r in rows:
        share[r["token"]] += Fraction(int(r["keep"]), int(r["capacity"]) * size)
        share[r["other"]] += Fraction(int(r["capacity"]) - int(r["keep"]), int(r["capacity"]) * size)
    return share


@pytest.mark.parametrize("counts", [[1], [5, 5, 5], [1, 1_000_000], [7, 1, 1, 1, 30, 2, 2, 9], [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8], [10**9] + [1] * 40, list(range(1, 200))])
@pytest.mark.parametrize("slices", [4])
def test_alias_table_holds_every_weight_exactly(spark, counts, slices):
    df = spark.createDataFrame([(10 * k - 50, c) for k, c in enumerate(counts)] + [(10_001, 0), (10_002, None)], "token long, cnt long")
    rows = sampling.alias_table(df, slices=slices).collect()
    weights = {10 * k - 50: int(np.floor(np.sqrt(float(c)) * np.sqrt(np.sqrt(float(c))) * 65_536)) for k, c in enumerate(counts)}
    assert sorted(r["slot"] for r in rows) == list(range(len(counts))) and all(0 <= r["keep"] <= r["capacity"] for r in rows)
    assert {t: s for t, s in exact_shares(rows).items() if s} == {t: Fraction(w, sum(weights.values())) for t, w in weights.items()}


def test_alias_arrays_hold_every_weight():
    rng = np.random.default_rng(3)
    for w in ([1.0], [2.0, 2.0], rng.random(500) ** 4, np.arange(1, 50) ** 0.75, np.array([1e6] + [1.0] * 30)):
        w = np.asarray(w, float)
        keep, other = sampling.alias_arrays(w)
        share = np.bincount(np.arange(len(w)), keep, len(w)) + np.bincount(other, 1 - keep, len(w))
        assert np.allclose(share / len(w), w / w.sum(), rtol=1e-9, atol=1e-12)
    drawn = np.bincount(sampling.alias_draws((keep, other), (100_000,), rng), minlength=len(w))
    assert abs(drawn[0] / 100_000 - w[0] / w.sum()) < 0.01


def test_negatives_follow_the_noise(spark):
    """Chi-square against count^0.75 over all tokens; every occurrence of a pair has its draws."""
    rng = np.random.default_rng(5)
    pairs = Counter(map(tuple, rng.zipf(1.6, (6_000, 2)).clip(max=60).tolist()))
    df = spark.createDataFrame([(a, b, n) for (a, b), n in pairs.items()], "center long, context long, n long")
    rows = sampling.negative_samples(df, 5, slices=5).collect()
    drawn, per = Counter(), Counter()
    for r in rows:
        drawn[r["negative"]] += r["n"]
        per[r["center"], r["context"]] += r["n"]
    assert per == {p: 5 * n for p, n in pairs.items()}
    counts = Counter()
    for (a, b), n in pairs.items():
        counts[a] += n
        counts[b] += n
    want = {t: c**0.75 for t, c in counts.items()}
    total, draws = sum(want.values()), sum(drawn.values())
    chi = sum((drawn[t] - draws * w / total) ** 2 / (draws * w / total) for t, w in want.items())
    assert chi < len(want) + 4 * np.sqrt(2 * len(want))
    assert rows != sampling.negative_samples(df, 5, seed=7).collect() and sorted(rows) == sorted(sampling.negative_samples(df, 5).collect())


def test_unfolding_cuts_long_rows(spark, monkeypatch):
    monkeypatch.setattr(sampling, "UNFOLD", 7)
    df = spark.createDataFrame([(1, 0, 30), (2, 30, 7), (3, 37, 1), (4, 38, 0)], "id long, first long, n long")
    assert sorted(r["number"] for r in sampling.unfolded(df, "first", "n", "number").collect()) == list(range(38))


@pytest.mark.parametrize("slices", [1, 6])
def test_non_edges_are_no_edges_and_even(spark, slices):
    rng = np.random.default_rng(9)
    pairs = sorted({tuple(p) for p in rng.integers(0, 12, (40, 2)).tolist() if p[0] != p[1]} | {(100, k) for k in range(11)})  # a hub
    df = spark.createDataFrame([(a * 10, b * 10) for a, b in pairs] + [(0, 10)] * 2, "src long, dst long")
    rows = sampling.non_edges(df, 400, slices=slices).collect()
    edges = {(r["src"], r["dst"]) for r in df.collect()}
    taken = edges | {(b, a) for a, b in edges}
    assert Counter((r["src"], r["dst"]) for r in rows) == {e: 400 for e in edges}
    drawn = Counter((r["neg_src"], r["neg_dst"]) for r in rows)
    nodes = {x for e in edges for x in e}
    free = {(a, b) for a in nodes for b in nodes if a != b} - taken
    assert set(drawn) == free
    mean = len(rows) / len(free)
    assert sum((n - mean) ** 2 / mean for n in drawn.values()) < len(free) + 4 * np.sqrt(2 * len(free))


def test_non_edge_edges(spark):
    whole = spark.createDataFrame([(a, b) for a in range(4) for b in range(a)], "src long, dst long")
    assert sampling.non_edges(whole).count() == 0 and sampling.non_edges(whole.limit(0)).count() == 0
    some = sampling.non_edges(spark.createDataFrame([(1, 2), (3, 4)], "src long, dst long"), 2, wanted=F.col("src") == 1).collect()
    assert {(r["src"], r["dst"]) for r in some} == {(1, 2)} and len(some) == 2


@pytest.mark.parametrize("slices", [1, 3, 50])
def test_sweeps_and_prefix_sums(spark, slices):
    rng = np.random.default_rng(slices)
    marks = [(int(x), int(v)) for x, v in zip(rng.integers(0, 100, 60), rng.integers(0, 1_000, 60))]
    points = [(int(x), k) for k, x in enumerate(rng.integers(-5, 120, 200))]
    found = relational.running_max_at(spark.createDataFrame(points, "x long, id long"), spark.createDataFrame(marks, "x long, v long"), "x", "v", slices).collect()
    assert {r["id"]: r["v"] for r in found} == {k: max((v for a, v in marks if a <= x), default=None) for x, k in points}
    rows = [(int(k), int(v)) for k, v in enumerate(rng.integers(1, 50, 300))]
    sums = relational.prefix_sums(spark.createDataFrame(rows, "k long, v long"), "k", "v", "s", slices).collect()
    assert {r["k"]: r["s"] for r in sums} == dict(enumerate(np.cumsum([v for _, v in rows]).tolist()))


def test_draws_of_a_pair_are_counted_where_they_are_drawn(spark):
    pairs = spark.range(300).selectExpr("id % 20 as center", "id as context", "1L as n")
    found = sampling.negative_samples(pairs, 3, slices=5)
    whole = found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1  # of the pairs, not of their draws
    assert sum(r["n"] for r in whole) == 900
    assert len({(r["center"], r["context"], r["negative"]) for r in whole}) == len(whole)


def test_ranges_are_looked_up_once_a_row_for_all_types(spark):
    df = spark.range(1_000).selectExpr("id * 3 as a", "cast(id as decimal(38,0)) as b", "'k' || id as c")
    for c in df.columns:
        bounds = relational.range_bounds(df, c, 50)
        own = df.select(c, relational.slice_of(F.col(c), bounds).alias("p")).collect()
        assert len(bounds) > 30 and all(r["p"] == sum(b <= r[c] for b in bounds) for r in own)


def test_kept_rows_are_compressed_and_made_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    kept = relational.kept_rows(spark.range(1_000).mapInArrow(counted, "id long"))
    assert kept.count() == 1_000 and seen.value == 1_000


def test_non_edges_are_sent_twice_at_most(spark, monkeypatch):
    """With places too many to be broadcast: draws go once to the sweep, which finds their first node too, and once to the second node."""
    monkeypatch.setattr(sampling, "broadcast_if_small", lambda df, *_: df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(60).selectExpr("id * 7 as src", "(id + 1) % 60 * 7 as dst")
        found = sampling.non_edges(df, 3, slices=5)
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        own = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and ("__p#" in x or "j#" in x or "i#" in x)]
        rows = found.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len([x for x in own if "(i#" in x]) == 0 and len(rows) == 180
    near = {frozenset(r) for r in df.collect()}
    assert all(r["neg_src"] != r["neg_dst"] and frozenset((r["neg_src"], r["neg_dst"])) not in near for r in rows)


def test_slots_beyond_one_broadcast_send_no_draw(spark, monkeypatch):
    """An alias table of several broadcasts: the same counts, and only the pairs are dealt."""
    pairs = spark.range(300).selectExpr("id % 20 as center", "id as context", "1L as n")
    whole = sorted(sampling.negative_samples(pairs, 3, slices=5).collect())
    monkeypatch.setattr(sampling, "SLOT_ROWS", 70)
    found = sampling.negative_samples(pairs, 3, slices=5)
    assert sorted(found.collect()) == whole
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    sent = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "Reused" not in x]
    assert len(sent) == 1 and "slot" not in sent[0] and "negative" not in sent[0]
