"""Toxic passages by maximum-scoring segments of token log-odds.

Tokens are words and, for words too rare to judge, their stems (leading letters). Their log-odds between
toxic and clean labelled texts have a Dirichlet prior centred on all of them; only features that stand
out of their own error count. A linear-time scan finds every maximal segment of a text, extreme-value
statistics say which of them chance would not bring, and a logistic curve turns the summed evidence of the
significant ones into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _base as B

STEMS = (6, 5, 4)
WORD = re.compile(r"[^\W\d_]+")
MEMO_WORDS = 300_000
#: Score of a token that tells nothing.
REST = -0.02
#: Parts of the labelled texts; what a part's evidence is judged by comes from the others.
FOLDS = 4
#: A passage is significant if chance brings so many of its score to a text of its length.
LEVEL = 0.05


def features(word: str) -> list[str]:
    """The word, then its stems from long to short; a stem is marked by an asterisk."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) >= k)]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in linear time, in order of position."""
    at = np.nonzero(scores > 0)[0]
    if not len(at):
        return []
    total = np.concatenate(([0.0], np.cumsum(scores, dtype=np.float64)))
    found: list[list[float]] = []  # start, end, sum before, sum after; earlier[i]: nearest with a smaller sum before
    earlier: list[int] = []
    for i in at.tolist():
        new = [i, i + 1, total[i], total[i + 1]]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = earlier[j]
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                earlier.append(j)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:], earlier[j:]
    return [(int(a), int(b), float(y - x)) for a, b, x, y in found]


@dataclass
class ToxicModel:
    scores: dict[str, float] = field(default_factory=dict)
    log_k: float = math.log(1e-4)
    curve: tuple[float, float] = (-2.0, 1.0)
    memo: dict[str, float] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def word(self, word: str) -> float:
        for f in features(word):
            if f in self.scores:
                return self.scores[f]
        return REST

    def chunk(self, chunk: str) -> float:
        words = WORD.findall(chunk.lower())
        return max(map(self.word, words)) if words else 0.0

    def token_scores(self, text: str | None) -> tuple[list[str], np.ndarray]:
        chunks = (text or "").split()
        memo = self.memo
        new = set(chunks).difference(memo)
        if len(memo) + len(new) > MEMO_WORDS:
            memo.clear()
            new = set(chunks)
        for c in new:
            memo[c] = self.chunk(c)
        return chunks, np.fromiter(map(memo.__getitem__, chunks), np.float64, len(chunks))

    def expected(self, tops: np.ndarray, m: int) -> np.ndarray:
        """How many segments of such scores or more chance brings to a text of m tokens."""
        return np.exp(np.minimum(50.0, self.log_k + math.log(max(1, m)) - tops))

    def summed(self, expected: np.ndarray) -> float:
        """-log10 of the chance expectations, summed over the significant ones."""
        return float(-np.log10(np.maximum(expected[expected <= LEVEL], 1e-300)).sum())

    def passages(self, scores: np.ndarray) -> list[tuple[int, int, float, float]]:
        """Significant segments: start, end, score and expected number by chance in a text so long."""
        found = segments(scores)
        chance = self.expected(np.array([s for *_, s in found]), len(scores))
        return [(a, b, s, float(e)) for (a, b, s), e in zip(found, chance) if e <= LEVEL]

    def evidence(self, scores: np.ndarray) -> float:
        return self.summed(np.array([e for *_, e in self.passages(scores)]))

    def probability(self, evidence: float) -> float:
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, a + b * evidence))))


@dataclass
class Tally:
    """Of each feature, by class (clean, toxic): documents that hold it and its occurrences; and those of all tokens."""

    docs: np.ndarray  # features x 2
    uses: np.ndarray  # features x 2
    all_docs: np.ndarray
    all_uses: np.ndarray

    def signed_z(self) -> np.ndarray:
        """Root of the likelihood ratio statistic of document counts, positive for toxic features."""
        n, total = self.docs.sum(axis=1), self.all_docs.sum()
        part = self.all_docs / max(1, total)
        held, free = n[:, None] * part, (total - n)[:, None] * part
        gain = sum((o * np.log(np.where(o > 0, o, 1) / np.maximum(e, 1e-9))).sum(axis=1) for o, e in ((self.docs, held), (self.all_docs - self.docs, free)))
        rate = self.docs / np.maximum(1, self.all_docs)
        return np.copysign(np.sqrt(np.maximum(0, 2 * gain)), rate[:, 1] - rate[:, 0])

    def log_odds(self, prior: float, prior_docs: float) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of occurrences and of documents; the Dirichlet priors are centred on both classes together."""

        def odds(own: np.ndarray, whole: np.ndarray, weight: float) -> np.ndarray:
            mean = weight * own.sum(axis=1, keepdims=True) / max(1, whole.sum())
            up = own + np.maximum(mean, 1e-9)
            logit = np.log(up / np.maximum(1e-9, whole + weight - up))
            return logit[:, 1] - logit[:, 0]

        return odds(self.uses, self.all_uses, prior), odds(self.docs, self.all_docs, prior_docs)


def learned(features_of: list[str], tally: Tally, least_z: float, least_odds: float, least_docs: int, prior: float, prior_docs: float = 2.0, burst: float = 1.5) -> dict[str, float]:
    """Scores of the features that tell toxic texts, and of those that share a stem with one.

    A score is the log-odds of occurrences; repetition within documents lifts it by `burst` above that of documents
    at most.
    """
    uses, docs = tally.log_odds(prior, prior_docs)
    score, least = np.minimum(uses, docs + burst), np.minimum(uses, docs)
    tells = (tally.signed_z() >= least_z) & (least >= least_odds) & (tally.docs[:, 1] >= least_docs)
    found = {features_of[i]: float(score[i]) for i in np.nonzero(tells)[0]}
    toxic = {f for f in found if f.endswith("*")}
    for i in np.nonzero(~tells & (tally.docs.sum(axis=1) >= 5))[0]:  # these speak for themselves
        f = features_of[i]
        if any(x in toxic for x in features(f.rstrip("*"))[1:] if x != f):
            found[f] = float(score[i]) if least[i] >= 0.5 else REST
    return found


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """Intercept and slope by Newton's method; the ridge keeps separable data finite."""
    w, design = np.zeros(2), np.stack((np.ones_like(x), x), axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T * (p * (1 - p)) @ design + ridge * np.eye(2), design.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labels: int = 12_000, prior: float = 2_000.0, least_z: float = 3.5, least_odds: float = 1.5, least_docs: int = 4, tail: float = 3.0) -> ToxicModel:
    """Learn from at most about `max_labels` labelled documents of each class, drawn by a hash of the id.

    labels: doc_id, toxic. Null ids, labels and texts teach nothing; of several labels of one id the
    highest counts. Without both classes every text gets the score of no evidence. Of texts whose smallest
    5-word shingle hash agrees (copies, nearly) one teaches, else the words of a copied text would look
    toxic. prior: weight, in tokens, of the Dirichlet prior. A feature needs `least_docs` toxic documents and
    `least_z` standard errors. tail: the score from which clean segments are counted for the extreme-value statistics.

    The statistics and the curve are fitted on evidence from features that were learned without the text's own fold.
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y"))
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return ToxicModel()
    part = F.when(F.col("y") == 1, F.lit(max_labels / sizes[1])).otherwise(F.lit(max_labels / sizes[0]))
    drawn = B.materialize(known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < part * 1_000_000), "drawn")
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null").join(F.broadcast(drawn), "doc_id")
    five = lambda w: F.array_min(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 5, F.lit(0))), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(5)))))
    fold = (F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / 3) % FOLDS).cast("int").alias("fold")
    first = text.withColumn("key", B.let(B.words_of(F.lower("text")), five)).groupBy("key").agg(F.min_by(F.struct("y", fold, "text"), F.struct("doc_id", "text")).alias("row"))
    rows = B.bounded_batches(B.materialize(first.select("row.*"), "taught"))
    names = [f"{what}{y}_{k}" for what in ("docs", "uses") for y in (0, 1) for k in range(FOLDS)]

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 2_000):
                held, used = Counter(), Counter()
                for y, k, text in zip(b["y"].iloc[lo : lo + 2_000], b["fold"].iloc[lo : lo + 2_000], b["text"].iloc[lo : lo + 2_000]):
                    own = Counter({"": 0})
                    for w, n in Counter(WORD.findall(text.lower())).items():
                        own[""] += n
                        for f in features(w):
                            own[f] += n
                    held.update((f, y, k) for f in own)
                    for f, n in own.items():
                        used[f, y, k] += n
                yield pd.DataFrame([(f, y, k, n, used[f, y, k]) for (f, y, k), n in held.items()], columns=["f", "y", "fold", "docs", "uses"])

    counts = rows.mapInPandas(tally, "f string, y int, fold int, docs long, uses long")
    sums = [F.sum(F.when((F.col("y") == int(c[4])) & (F.col("fold") == int(c[6:])), F.col(c[:4])).otherwise(0)).alias(c) for c in names]
    counts = B.materialize(counts.groupBy("f").agg(*sums), "tokens")
    whole = next(iter(counts.filter("f = ''").collect()), None)
    if not whole or not all(sum(whole[f"docs{y}_{k}"] for k in range(FOLDS)) for y in (0, 1)):
        return ToxicModel()
    docs0, docs1 = ("(" + " + ".join(f"docs{y}_{k}" for k in range(FOLDS)) + ")" for y in (0, 1))
    share = sum(whole[f"docs1_{k}"] for k in range(FOLDS)) / max(1, sum(whole[f"docs0_{k}"] for k in range(FOLDS)))
    tell = counts.filter((F.col("f") != "") & F.expr(f"{docs1} >= {least_docs} and {docs1} > {share} * {docs0}"))
    stem = F.explode(F.array(*(F.concat(F.substring("f", 1, k), F.lit("*")) for k in STEMS)))
    stems = tell.filter(F.endswith("f", F.lit("*"))).select(F.col("f").alias("stem"))  # what shares one speaks for itself
    akin = counts.filter(F.expr(f"{docs0} + {docs1} >= 5")).withColumn("stem", stem).filter("f != stem").join(stems, "stem", "left_semi").drop("stem")
    table = tell.unionByName(akin).distinct().orderBy("f").toPandas()
    features_of = table["f"].tolist()
    cells = {what: np.stack([np.stack([table[f"{what}{y}_{k}"].to_numpy(float) for y in (0, 1)], axis=1) for k in range(FOLDS)]) for what in ("docs", "uses")}
    alls = {what: np.array([[whole[f"{what}{y}_{k}"] for y in (0, 1)] for k in range(FOLDS)], float) for what in ("docs", "uses")}

    def without(fold: int | None) -> ToxicModel:
        own = [k for k in range(FOLDS) if k != fold]
        t = Tally(*(cells[w][own].sum(axis=0) for w in ("docs", "uses")), *(alls[w][own].sum(axis=0) for w in ("docs", "uses")))
        return ToxicModel(learned(features_of, t, least_z, least_odds, least_docs, prior))

    parts = [without(k) for k in range(FOLDS)]

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for y, k, text in zip(b["y"], b["fold"], b["text"]):
                s = parts[k].token_scores(text)[1]
                out.append((int(y), len(s), [x for *_, x in segments(s) if x >= 1]))
            yield pd.DataFrame(out, columns=["y", "m", "tops"])

    found = rows.mapInPandas(weigh, "y int, m long, tops array<double>").toPandas()
    model = without(None)
    clean = found[found["y"] == 0]
    # Gumbel tail with decay 1, as for any likelihood ratio: K m exp(-S) clean segments of score S or more.
    model.log_k = math.log(sum((t >= tail).sum() for t in map(np.asarray, clean["tops"])) + 1) + tail - math.log(clean["m"].sum() + 1)
    evidence = [model.summed(model.expected(np.asarray(t, float), m)) for t, m in zip(found["tops"], found["m"])]
    model.curve = logistic(np.array(evidence), found["y"].to_numpy(np.float64))
    return model


def score(docs: DataFrame, model: ToxicModel, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", with_passages: bool = False) -> DataFrame:
    """Rows id, score, predicted[, passages (text, start word, end word, expected by chance)]: one for every input row.

    A null or empty text has no passage and the score of no evidence. Rows are independent: repeated rows,
    null ids and other columns change nothing.
    """

    def run(texts: list[str | None]) -> tuple[None, pd.DataFrame]:
        out, spans = [], []
        for text in texts:
            chunks, s = model.token_scores(text)
            out.append(model.probability(model.evidence(s)))
            if with_passages:
                spans.append([{"text": " ".join(chunks[x:y]), "start": x, "end": y, "expected": e} for x, y, _, e in model.passages(s)])
        frame = pd.DataFrame({"score": out})
        frame["predicted"] = (frame["score"] >= threshold).astype("int32")
        if with_passages:
            frame["passages"] = spans
        return None, frame

    return B.beside(docs, [id_col], [text_col], run, "score double, predicted int" + ", passages array<struct<text:string,start:long,end:long,expected:double>>" * with_passages)


def score_held_out(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the training documents, score all: doc_id, held_out, score, predicted."""
    model = fit(docs, labels.filter(B.in_training(F.col("doc_id"))))
    return score(docs, model).select("doc_id", B.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents below the threshold, with all their columns; learned from all labelled documents."""
    model = fit(docs, labels)
    return B.filtered(docs, "text", lambda texts: np.array([model.probability(model.evidence(model.token_scores(t)[1])) < threshold for t in texts], bool))
