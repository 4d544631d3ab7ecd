"""URL filter: host and path rules first, then a ratio of character language models.

URLs that a rule allows or blocks teach two interpolated variable-order Markov models. A URL without a
rule is judged by its length-normalised log-likelihood difference against a cutoff calibrated on URLs
that taught nothing. All of it is DataFrame expressions: the models' interpolated log-ratio telescopes
into one value for each substring, so scoring sums looked-up values of a URL's substrings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _base as B

#: Fixed values: (verdict, rule); a rule is a host and a path prefix, the longest that fits wins.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
START, END = "\x02", "\x03"
ORDER = 5  # longest substring: a context of ORDER - 1 characters and the next one


def parts(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty for null or without `://`."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    host = lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """Struct of the longest fitting rule and its verdict; null where none fits. Of equally long rules the first wins."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules[::-1], key=lambda r: len(r[1])):
        own, slash, prefix = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(slash + prefix))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def substrings(text: Column) -> Column:
    """Every substring of up to ORDER characters of the padded text, by position."""
    padded = F.concat(F.lit(START), text, F.lit(END))
    n = F.length(padded)
    return B.let(padded, lambda p: F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(ORDER), n - i + 1)), lambda k: F.substring(p, i, k)))))


def fit(labelled: DataFrame) -> DataFrame:
    """gram, value, n: what each substring adds to ln P(accepted) - ln P(rejected), and how often it was seen.

    labelled: text, bad (0 accepted, 1 rejected). Counts cover every row. In both models the probability
    of a character after a context is (n + t p) / (N + t), with n of N occurrences, t distinct successors
    and p its probability after the context without its first character; at the end all characters are
    equally likely. A gram of which neither model has seen the context adds nothing.
    """
    spread = int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = labelled.groupBy("text", "bad").count().repartition(spread, "text").select("bad", "count", F.explode(substrings(F.col("text"))).alias("gram"))
    seen = counts.filter(F.col("gram") != START).groupBy("gram").agg(*(F.sum(F.when(F.col("bad") == b, F.col("count")).otherwise(0)).alias(f"n{b}") for b in (0, 1)))
    grams = B.materialize(seen.select("gram", F.length("gram").alias("size"), F.substring("gram", F.lit(1), F.length("gram") - 1).alias("context"), "n0", "n1"), "grams")
    contexts = B.materialize(grams.groupBy("context").agg(*(x for b in (0, 1) for x in (F.sum(f"n{b}").alias(f"all{b}"), F.sum((F.col(f"n{b}") > 0).cast("long")).alias(f"types{b}")))), "contexts")
    alphabet = grams.filter("size = 1").count() + 1
    low, values = None, None
    for size in range(1, ORDER + 1):
        own = grams.filter(F.col("size") == size).join(contexts, "context")
        if low is None:
            own = own.withColumn("p0", F.lit(1 / alphabet)).withColumn("p1", F.lit(1 / alphabet))
        else:
            own = own.withColumn("shorter", F.substring("gram", 2, size)).join(low, "shorter", "left").na.fill(1 / alphabet, ["p0", "p1"])
        for b in (0, 1):  # a context that a model has not seen leaves the shorter one's probability
            own = own.withColumn(f"q{b}", F.when(F.col(f"all{b}") > 0, (F.col(f"n{b}") + F.col(f"types{b}") * F.col(f"p{b}")) / (F.col(f"all{b}") + F.col(f"types{b}"))).otherwise(F.col(f"p{b}")))
        own = B.materialize(own.withColumn("step", F.ln(F.col("q0") / F.col("q1")) - F.ln(F.col("p0") / F.col("p1"))), f"order{size}")
        low = own.select(F.col("gram").alias("shorter"), F.col("q0").alias("p0"), F.col("q1").alias("p1"))
        values = own.select("gram", "context", "step") if values is None else values.unionByName(own.select("gram", "context", "step"))
    left = lambda b: F.when(F.col(f"all{b}") > 0, F.col(f"types{b}") / (F.col(f"all{b}") + F.col(f"types{b}"))).otherwise(F.lit(1.0))
    backoff = contexts.select("context", F.ln(left(0) / left(1)).alias("beta"))
    grams_value = values.join(backoff, "context").select("gram", (F.col("step") - F.col("beta")).alias("value"))
    return B.materialize(grams_value.unionByName(backoff.select(F.col("context").alias("gram"), F.col("beta").alias("value"))).groupBy("gram").agg(F.sum("value").alias("value")).join(grams.select("gram", (F.col("n0") + F.col("n1")).alias("n")), "gram", "left").na.fill(0, ["n"]), "values")


def ratios(texts: DataFrame, model: DataFrame) -> DataFrame:
    """text, ratio: length-normalised log-likelihood difference of each distinct text, larger for accepted ones.

    The empty context occurs at every predicted character, so its value is a constant of the ratio.
    """
    always = model.filter("gram = ''").select("value").first()
    spread = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # each text becomes hundreds of rows
    own = texts.select("text").repartition(spread, "text").distinct().select("text", F.explode(substrings(F.col("text"))).alias("gram"))
    values = model.select("gram", "value")
    if B.small_enough(model):
        found = own.join(F.broadcast(values), "gram", "left").select("text", "value")
    else:  # the grams that these texts hold most often are broadcast, known to the models or not; none of the others is frequent
        common = own.groupBy("gram").agg(F.count("*").alias("uses")).orderBy(F.desc("uses"), "gram").limit(B.BROADCAST_ROWS).select("gram")
        often = B.materialize(common.join(values, "gram", "left").withColumn("common", F.lit(True)), "common")
        first = own.join(F.broadcast(often), "gram", "left")
        rest = first.filter("common is null").select("text", "gram").join(values, "gram").select("text", "value")
        found = first.select("text", "value").unionByName(rest)
    return found.groupBy("text").agg((F.sum(F.coalesce("value", F.lit(0.0))) / (F.length("text") + 1) + F.lit(always["value"] if always else 0.0)).alias("ratio"))


def calibrate(scored: DataFrame) -> float:
    """The cutoff with the best balanced accuracy on (ratio, bad, n), halfway to the next lower ratio; ties go to the one nearest 0."""
    whole = scored.agg(F.sum(F.when(F.col("bad") == 0, F.col("n"))).alias("good"), F.sum(F.when(F.col("bad") == 1, F.col("n"))).alias("bad")).first()
    if not whole["good"] or not whole["bad"]:
        return 0.0
    binned = scored.groupBy(F.round("ratio", 3).alias("cut")).agg(F.sum(F.when(F.col("bad") == 0, F.col("n")).otherwise(0)).alias("g"), F.sum(F.when(F.col("bad") == 1, F.col("n")).otherwise(0)).alias("b"))
    up = Window.orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    gain = F.coalesce(F.sum("b").over(up), F.lit(0)) / whole["bad"] - F.coalesce(F.sum("g").over(up), F.lit(0)) / whole["good"]
    half = (F.col("cut") + F.coalesce(F.lag("cut").over(Window.orderBy("cut")), F.col("cut"))) / 2
    return float(binned.select(gain.alias("gain"), half.alias("cut")).orderBy(F.desc("gain"), F.abs("cut")).first()["cut"])


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, ratio: one row for every page.

    A null url or one without `://` has empty host and path, no rule, and is judged by the models as the
    empty text. Without both accepted and rejected URLs to learn from, all ratios are 0 and every URL
    without a rule is allowed. Repeated rows and ids keep their rows; other columns are ignored.

    Four of five distinct labelled URLs (by a hash) teach the models, the fifth sets the cutoff.
    """
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    rows = B.materialize(rows.withColumn("found", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "found.*", F.when(F.col("url").contains("://"), F.concat("host", F.regexp_extract("url", r"(?s)://[^/?#]*(.*)", 1))).otherwise("url").alias("text")), "urls")
    known = rows.filter("rule is not null").select("text", (F.col("verdict") == "block").cast("int").alias("bad"))
    aside = F.pmod(F.xxhash64("text"), F.lit(5)) == 0
    model = fit(known.filter(~aside))
    scores = B.materialize(ratios(rows, model), "ratios")
    held = known.filter(aside).groupBy("text", "bad").agg(F.count("*").alias("n")).join(scores, "text")
    cut = calibrate(held)
    sizes = rows.groupBy("text").agg(F.count("*").alias("n")).join(scores, "text")
    judged = B.skew_join(rows, sizes, "text", "n", rows.count())
    return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("ratio") >= cut, F.lit("allow")).otherwise(F.lit("block"))).alias("verdict"), "ratio")
