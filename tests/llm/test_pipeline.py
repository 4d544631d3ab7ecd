"""The pipeline against plain Python on a small corpus with a case of each kind."""

import random

import pandas as pd
import pytest

import corpus_pipeline
from lattica.llm import bpe
from tests.llm.test_operators import DIR, PATH, base_counts, brute_components, toxic_rows


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    rng = random.Random(11)
    rows, labels = toxic_rows(500, 7)
    vocabulary = ["".join(rng.choices("bcdfgl", k=6)) for _ in range(3000)]
    item = " ".join(rng.choices(vocabulary, k=30))
    clean = lambda: rng.choices(vocabulary, k=80)
    rows = [(i, t) for i, t in rows]
    for i in range(500, 520):
        base = clean()
        rows.append((i, " ".join(base)))
        rows.append((i + 100, " ".join(base).upper()))  # a copy but for case
        rows.append((i + 200, " ".join([*base, "more"])))  # a near copy
    rows += [(800 + i, " ".join(clean()[:40]) + f" {item} " + " ".join(clean()[:40])) for i in range(5)]
    rows += [(900, "too few words"), (901, None), (902, ""), (903, "a b c d e f " * 10), (None, " ".join(clean()))]
    folder = tmp_path_factory.mktemp("corpus")
    pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], "Int64"), "text": [r[1] for r in rows], "lang": "en", "source": "s", "n_chars": pd.array([len(r[1] or "") for r in rows], "Int64")}).to_parquet(folder / "documents.parquet")
    pd.DataFrame(labels, columns=["doc_id", "toxic"]).assign(quality=1).astype({"doc_id": "int64"}).to_parquet(folder / "labels.parquet")
    pd.DataFrame([(1, item)], columns=["item_id", "text"]).to_parquet(folder / "benchmark.parquet")
    return str(folder), rows, item


def plain_survivors(rows, item):
    toxic = ("Vile!", "awful", "grimlo")
    left = [(i, t) for i, t in rows if not ((c := base_counts(t))[0] < 10 or 100 * c[4] > 20 * c[0])]
    left = [(i, t) for i, t in left if not any(w in t for w in toxic)]
    names = brute_components([(i, t) for i, t in left if i is not None])
    left = [(i, t) for i, t in left if i is None or names[i][1] == i]  # no text without an id has a copy here
    return {i: t for i, t in left if item not in t}


def test_pipeline_against_plain_python(spark, corpus):
    folder, rows, item = corpus
    want = plain_survivors(rows, item)
    got = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, folder).collect()}
    assert got.keys() == want.keys()
    codec = bpe.codec(PATH)
    assert all(got[i] == len(codec.encode(t)) for i, t in want.items())


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "near_dedup", "decontaminate", "bpe_roundtrip"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs.limit(0), DIR)
        assert left.columns == docs.columns and left.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), DIR).count() == 0
