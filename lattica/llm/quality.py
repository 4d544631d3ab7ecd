"""Quality rules with risk-controlled cutoffs, in DataFrame expressions only.

Each rule rejects a text whose metric reaches a cutoff. Cutoffs come from labelled documents. Every set of rules is a
path: at each step, from mild to strict, all its rules take their next cutoffs together, and the exact binomial tail
tests whether what they reject together is more than its share of good documents, until a test fails. The error level
is divided among strata and paths, and the best certified step of a stratum is taken: with probability 1 - delta no
stratum loses more than alpha of its good documents to the rules.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _base as B

#: Rule -> ascending cutoffs of its metric. Fixed beforehand, so no labels are spent on choosing a grid.
GRID = {
    "symbol_ratio": [round(0.01 * 1.2**i, 4) for i in range(24)],
    "upper_ratio": [round(0.10 + 0.0375 * i, 4) for i in range(24)],
    "mark_ratio": [round(0.02 * 1.2**i, 4) for i in range(24)],
    "dup_line_ratio": [round(0.05 + 0.04 * i, 4) for i in range(24)],
    "repeat_ratio": [round(0.01 + 0.008 * i, 4) for i in range(24)],
}
STEPS = 24
#: All sets of rules, by their positions in GRID. Fixed beforehand, as the grid is.
PATHS = [p for k in range(1, len(GRID) + 1) for p in combinations(range(len(GRID)), k)]
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(words: Column) -> Column:
    """Words inside 5-word windows that the list holds twice or more, the first ones included."""
    n = F.size(words)

    def covered(windows: Column) -> Column:
        def of(spots: Column) -> Column:
            step = F.transform(spots, lambda p, j: F.least(F.lit(5), F.coalesce(F.get(spots, j + 1) - p, F.lit(5))))
            return F.aggregate(step, F.lit(0), lambda a, x: a + x)

        def twice(rows: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(rows, j)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(rows, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))

        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        found = B.let(B.let(ordered, twice), of)
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(found)

    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(5))))

    return F.when(n < 6, F.lit(0)).otherwise(B.let(B.let(F.transform(words, lambda w: F.xxhash64(w)), windows), covered))


def measures(text: Column) -> Column:
    """Struct of the counts and metrics of a whole text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))

    def of(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        dup = B.let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            repeat_words(words).cast("long").alias("n_repeat_words"),
            F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
            F.regexp_count(text, F.lit(r"[!?]")).cast("long").alias("n_marks"),
            dup.alias("dup"),
        )

    def metrics(m: Column) -> Column:
        part = lambda a, b: (a / F.greatest(b, F.lit(1))).cast("double")
        return F.struct(
            m["n_words"].alias("n_words"),
            m["word_chars"].alias("word_chars"),
            m["n_symbols"].alias("n_symbols"),
            m["dup"]["n_dup_lines"].cast("long").alias("n_dup_lines"),
            m["n_repeat_words"].alias("n_repeat_words"),
            ((m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])).alias("base_failed"),
            part(m["n_symbols"], m["word_chars"]).alias("symbol_ratio"),
            part(m["n_upper"], m["word_chars"]).alias("upper_ratio"),
            part(m["n_marks"], m["n_words"]).alias("mark_ratio"),
            part(m["dup"]["n_dup_lines"], m["dup"]["n_lines"]).alias("dup_line_ratio"),
            part(m["n_repeat_words"], m["n_words"]).alias("repeat_ratio"),
        )

    return B.let(B.let(B.words_of(text), of), metrics)


def ln_gamma(x: Column) -> Column:
    """Lanczos' series; relative error below 1e-14 for x >= 1."""
    # Lanczos coefficients for g = 7.
    c = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]
    z = x - 1
    series = F.lit(c[0])
    for i, a in enumerate(c[1:], 1):
        series = series + F.lit(a) / (z + i)
    return F.lit(0.9189385332046727) + (z + 0.5) * F.ln(z + 7.5) - (z + 7.5) + F.ln(series)


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """P(Binomial(n, p) <= k) for k < n p, else 1: the terms from k downwards, to ten standard deviations.

    What lies below is less than 1e-20 of the sum.
    """
    log_top = ln_gamma(n + 1.0) - ln_gamma(k + 1.0) - ln_gamma(n - k + 1.0) + k * F.ln(p) + (n - k) * F.ln(1 - p)
    ratio = lambda i: i * (1 - p) / ((n - i + 1) * p)  # noqa: E731  term i-1 over term i
    far = 10 * F.sqrt(n * p * (1 - p)) + 100
    steps = F.when((k >= 1) & (k < n * p), F.sequence(F.lit(0), F.least(k - 1, far).cast("int"))).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    total = F.aggregate(steps, start, lambda a, i: F.struct((a["term"] * ratio(k - i)).alias("term"), (a["sum"] + a["term"] * ratio(k - i)).alias("sum")))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(log_top) * total["sum"]))


def trials(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """stratum, quality, levels (of each rule the number of cutoffs reached): one row for each id, then for each text.

    Of an id's texts the one of smallest digest counts, and the highest of its labels; so copies and repeated rows
    are one trial.
    """
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    reached = lambda metric, grid: F.aggregate(F.array(*map(F.lit, grid)), F.lit(0), lambda a, c: a + (metric >= c).cast("int"))
    level = [reached(F.col(r), g) for r, g in GRID.items()]
    rows = measured.filter("not base_failed and doc_id is not null").select("doc_id", "text_key", F.struct("stratum", F.array(*level).alias("levels")).alias("x"))
    own = lambda df, *more: df.groupBy("doc_id", *more).agg(F.min("text_key").alias("text_key"), F.min_by("x", "text_key").alias("x"))
    few = B.small_enough(known)
    one = own(rows.join(F.broadcast(known), "doc_id"), "quality") if few else own(rows).join(known, "doc_id")
    return one.groupBy("x.stratum", "text_key").agg(F.max("quality").alias("quality"), F.first("x.levels").alias("levels")).select("stratum", "quality", "levels")


def fit_cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05, gain: float = 0.99) -> DataFrame:
    """One row a stratum with a certified step: stratum and, for each rule, its cutoff or null where it takes no part.

    measured: doc_id, text_key, stratum, base_failed and the metrics. labels: doc_id, quality (null teaches
    nothing). Of the certified steps that catch `gain` of the bad documents which the best one catches, that is
    taken which loses fewest good ones, then the mildest, then the first path.
    """
    level_on = lambda path: F.greatest(*(F.col("levels")[i] for i in path), F.lit(0))
    spots = F.array(*(F.struct(F.lit(k).alias("path"), level_on(p).alias("level")) for k, p in enumerate(PATHS)))
    good, bad = (F.sum((F.col("quality") == q).cast("long")).alias(n) for q, n in ((1, "good"), (0, "bad")))
    tally = B.materialize(trials(measured, labels).select("stratum", "quality", F.explode(spots).alias("x")).groupBy("stratum", "x.path", "x.level").agg(good, bad), "tally")
    grid = F.explode(F.sequence(F.lit(0), F.lit(STEPS)))
    cells = tally.select("stratum", "path").distinct().select("stratum", "path", grid.alias("level")).join(tally, ["stratum", "path", "level"], "left").na.fill(0, ["good", "bad"])
    whole = Window.partitionBy("stratum", "path")
    down = whole.orderBy(F.desc("level"))
    tests = tally.agg((F.greatest(F.countDistinct("stratum"), F.lit(1)) * len(PATHS)).alias("tests"))
    own = cells.select("*", F.sum("good").over(whole).alias("n"), F.sum("good").over(down).alias("k"), F.sum("bad").over(down).alias("caught")).filter("level > 0").crossJoin(F.broadcast(tests))
    passed = own.withColumn("ok", (binomial_tail(F.col("k").cast("double"), F.col("n").cast("double"), F.lit(alpha)) <= F.lit(delta) / F.col("tests")) & (F.col("n") > 0))
    certified = passed.withColumn("ok", F.min("ok").over(down)).filter("ok and caught > 0").withColumn("best", F.max("caught").over(Window.partitionBy("stratum")))
    chosen = certified.filter(F.col("caught") >= gain * F.col("best")).groupBy("stratum").agg(F.min_by(F.struct("path", "level"), F.struct("k", -F.col("level"), "path")).alias("x"))
    takes = F.element_at(F.array(*(F.array(*(F.lit(i in p) for i in range(len(GRID)))) for p in PATHS)), F.col("x.path") + 1)
    cutoff = lambda i, g: F.when(takes[i], F.element_at(F.array(*map(F.lit, g)), F.col("x.level")))
    return chosen.select("stratum", *(cutoff(i, g).alias(f"{r}_cutoff") for i, (r, g) in enumerate(GRID.items())))


def stratum(lang: Column) -> Column:
    return F.coalesce(lang.cast("string"), F.lit("und"))


def verdict() -> Column:
    """False for a base failure or a metric at its cutoff; a rule without a cutoff rejects nothing."""
    hit = F.lit(False)
    for r in GRID:
        hit = hit | F.coalesce(F.col(r) >= F.col(f"{r}_cutoff"), F.lit(False))
    return ~(F.col("base_failed") | hit)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", whole: bool = False) -> DataFrame:
    """doc_id, stratum, text_key, the counts and metrics of every row[, and the row as it is]."""
    key = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_key")
    own = docs.select(F.col(id_col).alias("doc_id"), stratum(F.col(lang_col)).alias("stratum"), key, measures(F.col(text_col)).alias("m"), *([F.struct("*").alias("row")] if whole else []))
    return own.select("doc_id", "stratum", "text_key", "m.*", *(["row"] if whole else []))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the five counts, base_failed, kept: one row for every document.

    A null or empty text has no words and fails the base; a null lang is a stratum of its own; a null
    or repeated doc_id is judged by its own text (labels of a null id teach nothing, of several labels
    of one id or one text the highest counts). Without enough labels no cutoff is certified and only the base
    rejects. Other columns are ignored.
    """
    measured = B.materialize(measure(docs), "measures")
    cutoffs = B.materialize(fit_cutoffs(measured, labels), "cutoffs")
    right = F.broadcast(cutoffs) if B.small_enough(cutoffs, 10_000) else cutoffs
    return measured.join(right, "stratum", "left").select("doc_id", *COUNTS, "base_failed", verdict().alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that `judge` keeps, with all their columns. Texts are measured once, written with their measures, and never shuffled."""
    measured = B.materialize(measure(docs, whole=True), "measures")
    cutoffs = B.materialize(fit_cutoffs(measured, labels), "cutoffs")
    right = F.broadcast(cutoffs) if B.small_enough(cutoffs, 10_000) else cutoffs
    return measured.join(right, "stratum", "left").filter(verdict()).select("row.*")
