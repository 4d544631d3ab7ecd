"""Token counts through a digest cache: only contents never counted before are encoded."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _base as B
from .bpe import codec

#: Cold caches would broadcast a table as large as the corpus; only this many misses are broadcast.
FEW_MISSES = 10_000
CACHE = "digest binary, tokenizer string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """Version of a tokenizer: its file and the settings that counts depend on."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + b"\0no added, begin or end tokens; no truncation; no padding").hexdigest()


def counter(path: str):
    """list of texts -> list of token counts, by the library that reads the file."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    own = codec(path)
    if own.drops_space:
        return lambda texts: [len(x) // 4 for x in own.encode_batch(texts)]
    own.library.no_truncation()
    own.library.no_padding()
    return lambda texts: [len(x) for x in own.library.encode_batch(texts, add_special_tokens=False)]


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    try:
        return spark.read.schema(CACHE).parquet(cache)
    except AnalysisException:  # nothing was ever counted
        return spark.createDataFrame([], CACHE)


def first_rows(whole: DataFrame, missing: DataFrame, total: int) -> DataFrame:
    """(digest, text) of the missing digests: one row of each that is few or frequent, else rows that meet in one task.

    missing: digest, n rows of whole with it. Frequent digests number B.HOT_KEYS at most; each task brings one row of
    each to the shuffle. Rows of the others are shuffled as they are.
    """
    one = lambda own: whole.join(F.broadcast(own.select("digest")), "digest").groupBy("digest").agg(F.first("text").alias("text"))
    if B.small_enough(missing, FEW_MISSES):
        return one(missing)
    least = max(64, -(-total // B.HOT_KEYS))
    hot, rest = missing.filter(F.col("n") >= least), missing.filter(F.col("n") < least).select("digest")
    cold = whole.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(rest.hint("shuffle_hash"), "digest", "left_semi")
    return one(hot).unionByName(cold.select("digest", "text"))


def count_tokens(docs: DataFrame, path: str, cache: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows id, n_bytes, n_tokens, over_limit: one for every input row.

    cache: folder of counts by (content digest, tokenizer digest), read first and appended to; without
    one, a fresh folder in shared storage. A null text counts as empty: 0 bytes, 0 tokens. Equal texts
    are encoded once, whatever their ids; rows with null or repeated ids keep their own rows; other
    columns are ignored. An empty table gives an empty result.

    Texts that are not in the cache move once to the place that encodes them, by digest. Of the texts with
    many copies each task sends one, so no group of copies meets in one task, whatever the ids; counts go back by
    digest with frequent digests broadcast.
    """
    spark, version = docs.sparkSession, tokenizer_digest(path)
    cache = cache or f"{B.shared_dir(spark)}/lattica-llm/{uuid.uuid4().hex}/counts"
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    keyed = B.materialize(whole.select("id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    groups = B.materialize(keyed.groupBy("digest").agg(F.count("*").alias("n")), "contents")

    known = read_cache(spark, cache).filter(F.col("tokenizer") == version).select("digest").distinct()
    todo = first_rows(whole.select("digest", "text"), groups.join(known, "digest", "left_anti"), keyed.count())

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, done = counter(path), set()
        for b in batches:
            for lo in range(0, len(b), 500):
                part = b.iloc[lo : lo + 500].drop_duplicates("digest")
                part = part[~part["digest"].isin(done)]  # repeated rows
                done.update(part["digest"])
                yield pd.DataFrame({"digest": part["digest"], "tokenizer": version, "n_tokens": count(part["text"].tolist())})

    counted = B.bounded_batches(todo).mapInPandas(encode, CACHE).groupBy("digest", "tokenizer").agg(F.max("n_tokens").alias("n_tokens"))
    counted.write.mode("append").parquet(cache)

    counts = read_cache(spark, cache).filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    out = B.skew_join(keyed, groups.select("digest", "n").join(counts, "digest"), "digest", "n", keyed.count())
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
