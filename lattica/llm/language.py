"""Language identification by multilingual mixture inference.

Character trigrams of every training language give word likelihoods; expectation-maximisation over
the words of a document estimates the proportions of its languages, and the penalised likelihood of
nested language sets decides how many of them the document holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _base as B

#: Hashed trigrams of a model, which takes four bytes for each of them and language: 256 kB a language.
BUCKETS = 1 << 16
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of a text and the offsets at which its words begin.

    Letters are lower-cased, each run of other characters is one boundary.
    """
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[cp]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cp = np.concatenate(([0], np.where(letter, cp, 0), [0])).astype(np.uint64)
    cp = cp[np.concatenate(([True], (cp[1:] != 0) | (cp[:-1] != 0)))]
    h = (cp[:-2] * np.uint64(0x9E3779B97F4A7C15) + cp[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + cp[2:] * np.uint64(0x165667B19E3779F9)) * np.uint64(0xD6E8FEB86659FD93)
    inner = cp[1:-1] != 0
    starts = np.nonzero(cp[:-2] == 0)[0]
    ranks = np.concatenate(([0], np.cumsum(inner)))
    return (h[inner] >> np.uint64(48)).astype(np.int64), ranks[starts]


@dataclass
class LanguageModel:
    langs: list[str]
    logp: np.ndarray  # BUCKETS x languages, float32

    def word_scores(self, text: str | None) -> np.ndarray:
        """Words x languages of log-likelihoods."""
        g, starts = grams(text)
        return np.add.reduceat(self.logp[g], starts, axis=0) if len(g) else np.empty((0, len(self.langs)), np.float32)


def mixture(scores: np.ndarray, rounds: int = 40, tol: float = 1e-4) -> tuple[np.ndarray, float]:
    """Proportions and log-likelihood of the words' mixture."""
    top = scores.max(axis=1, keepdims=True)
    like = np.exp((scores - top).astype(np.float64))
    share = np.full(scores.shape[1], 1 / scores.shape[1])
    for _ in range(rounds):
        joint = like @ share
        new = share * (like.T @ (1 / joint)) / len(like)
        done = np.abs(new - share).max() < tol
        share = new
        if done:
            break
    return share, float(np.log(like @ share).sum() + top.sum())


def infer(scores: np.ndarray, penalty: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Chosen languages, largest first, and their proportions.

    Each further language costs `penalty` times the log of the word count. No set can fit better than
    the mixture of all languages, so where that does not pay for one more, the best single one stays.
    """
    single = scores.sum(axis=0, dtype=np.float64)
    best = int(single.argmax())
    cost = penalty * np.log(max(2, len(scores)))
    bound = scores.max(axis=1).sum(dtype=np.float64) - cost
    if scores.shape[1] == 1 or bound <= single[best]:
        return np.array([best]), np.ones(1)
    share, full = mixture(scores)
    if full - cost <= single[best]:
        return np.array([best]), np.ones(1)
    order = np.argsort(-share, kind="stable")
    found, value = (np.array([best]), np.ones(1)), single[best]
    for k in range(2, scores.shape[1] + 1):
        if full - cost * (k - 1) <= value:
            break
        own = order[:k]
        part, ll = mixture(scores[:, own])
        if ll - cost * (k - 1) > value:
            rank = np.argsort(-part, kind="stable")
            found, value = (own[rank], part[rank]), ll - cost * (k - 1)
    return found


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs_per_lang: int = 6_000, alpha: float = 0.05) -> LanguageModel:
    """Learn from at most about `max_docs_per_lang` documents of each language, drawn by a hash of the id.

    Rows with null text or language teach nothing. Every language of the rows is learned.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("lang is not null and text is not null")
    sizes = rows.groupBy("lang").count().collect()
    langs = sorted(r["lang"] for r in sizes)
    if not langs:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32))
    keep = F.broadcast(rows.sparkSession.createDataFrame([(r["lang"], max_docs_per_lang / r["count"]) for r in sizes], "lang string, part double"))
    drawn = rows.join(keep, "lang").filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.col("part") * 1_000_000).select("lang", "text")

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, own in b.groupby("lang")["text"]:
                n = np.bincount(np.concatenate([grams(text)[0] for text in own]), minlength=BUCKETS)
                at = np.nonzero(n)[0]
                yield pd.DataFrame({"lang": lang, "bucket": at, "n": n[at]})

    counts = B.bounded_batches(drawn).mapInPandas(tally, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    column = {lang: i for i, lang in enumerate(langs)}
    table = np.zeros((BUCKETS, len(langs)))
    table[counts["bucket"].to_numpy(np.int64), [column[x] for x in counts["lang"]]] = counts["n"].to_numpy()
    return LanguageModel(langs, np.log((table + alpha) / (table.sum(axis=0) + alpha * BUCKETS)).astype(np.float32))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows id, lang_pred, score, languages (array of lang and share, largest first): one for every input row.

    `und` with score 0 and no languages for a null text, a text without a letter, or a model without a
    language. score: share of lang_pred in the document. Ties go to the language first in the alphabet.
    Rows are independent; repeated rows, null ids and other columns change nothing.
    """

    def run(texts: list[str | None]) -> tuple[None, pd.DataFrame]:
        pred, score, langs = [], [], []
        for text in texts:
            words = model.word_scores(text) if model.langs else ()
            if not len(words):
                pred.append("und"), score.append(0.0), langs.append([])
                continue
            who, share = infer(words)
            pred.append(model.langs[who[0]]), score.append(min(1.0, float(share[0])))
            langs.append([{"lang": model.langs[i], "share": float(s)} for i, s in zip(who, share)])
        return None, pd.DataFrame({"lang_pred": pred, "score": score, "languages": langs})

    return B.beside(docs, [id_col], [text_col], run, "lang_pred string, score double, languages array<struct<lang:string,share:double>>")


def identify_held_out(docs: DataFrame) -> DataFrame:
    """Fit on the training documents, predict all: doc_id, held_out, lang_pred, score, languages."""
    model = fit(docs.filter(B.in_training(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", B.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "languages")
