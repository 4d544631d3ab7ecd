"""Benchmark decontamination by spaced seeds.

Fixed masks pick some positions of a token window and ignore the others, so a passage with substituted
tokens still shares seeds with its benchmark item. Seeds of training texts are joined with those of the
benchmark, and the overlap around each hit is verified token by token.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _base as B
from . import spans

#: Positions that count; no two masks ignore the same ones.
MASKS = ("111111", "11011011", "110100111", "1100101011")
LONGEST = max(map(len, MASKS))
#: An overlap holds at least this part of the item, this part of its own span, and so many tokens.
LEAST, IDENTITY, LEAST_TOKENS = 0.5, 0.75, 8
#: So many matched tokens are enough whatever the item's length.
ENOUGH = 50
#: Diagonals so near each other may be one passage with words put in or left out, if each holds PIECE matched tokens.
NEAR, PIECE = 8, 6
MEMO_WORDS = 100_000
#: Places of a seed in the benchmark that one row lists, give or take chance.
PLACES = 1_000
#: Digests of contaminated texts that are broadcast at most, 16 bytes each.
KEYS = 500_000
OTHER = 1  # code of every token that the benchmark does not hold


def code_of(token: str) -> int:
    return xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass")) | 2


def window_seeds(codes: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the windows of which every counted token is one of the benchmark's."""
    size = len(codes) - int(mask[-1])
    if size <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    known = codes > OTHER
    ok = known[mask[0] : mask[0] + size].copy()
    for o in mask[1:]:
        ok &= known[o : o + size]
    at = np.nonzero(ok)[0]
    h = np.full(len(at), int(mask[-1]), np.uint64)
    for o in mask:
        h = (h ^ codes[at + o]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h, at


def masks_for(lengths: set[int]) -> list[np.ndarray]:
    """The masks, and one for each length of an item too short for the longest of them, which matches as a whole."""
    return [np.nonzero([c == "1" for c in m])[0] for m in MASKS] + [np.arange(n) for n in sorted(lengths)]


class Probe:
    """Looks for hits of the benchmark's seeds in documents; its filters grow with the benchmark up to 128 MB each."""

    def __init__(self, masks: list[np.ndarray], longest: int, tokens: B.BitFilter, seeds: B.BitFilter):
        self.masks, self.longest, self.tokens, self.seeds, self.memo = masks, longest, tokens, seeds, {}

    def number(self, texts: list[str | None]) -> list[np.ndarray]:
        """Codes of each text's tokens; chunks without letters or digits are left out."""
        split = [(t or "").split() for t in texts]
        new = set(chain.from_iterable(split)).difference(self.memo)
        if len(self.memo) + len(new) > MEMO_WORDS:
            self.memo = {}
            new = set(chain.from_iterable(split))
        named = {c: n for c in new if (n := spans.normal(c))}
        codes = np.fromiter(map(code_of, named.values()), np.uint64, len(named))
        self.memo.update(dict.fromkeys(new, 0))
        self.memo.update(zip(named, np.where(self.tokens.has(codes), codes, np.uint64(OTHER)).tolist()))
        found = (np.fromiter(map(self.memo.__getitem__, x), np.uint64, len(x)) for x in split)
        return [x[x > 0] for x in found]

    def hits(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text its hits' hashes and positions, and the codes about them."""
        for lo, hi in spans.batches(texts, 500_000):
            docs = self.number(texts[lo:hi])
            flat, starts = spans.joined([d.view(np.int64) for d in docs], LONGEST)
            flat = flat.view(np.uint64)
            own = [window_seeds(flat, m) for m in self.masks]
            h, at = (np.concatenate([x[k] for x in own]) for k in (0, 1))
            passed = self.seeds.has(h)
            h, at = h[passed], at[passed]
            order = np.argsort(at, kind="stable")
            h, at = h[order], at[order]
            cut = np.searchsorted(at, starts)
            for d, doc in enumerate(docs):
                pos = at[cut[d] : cut[d + 1]] - starts[d]
                yield h[cut[d] : cut[d + 1]], pos, self.about(doc, pos)

    def about(self, doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """The document's codes with 0 where no hit is within an item's reach; nothing without hits."""
        if not len(pos):
            return doc[:0]
        reach, edge = self.longest + NEAR, np.zeros(len(doc) + 1, np.int64)
        np.add.at(edge, np.maximum(0, pos - reach), 1)
        np.add.at(edge, np.minimum(len(doc), pos + reach), -1)
        return np.where(np.cumsum(edge)[:-1] > 0, doc, np.uint64(0))


class Benchmark:
    """A benchmark's items and seeds as tables, and the probe for them."""

    def __init__(self, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text"):
        rows = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).filter("item_id is not null and text is not null").distinct()
        named = B.materialize(rows.withColumn("item", F.monotonically_increasing_id()), "items")

        def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                codes = [np.array([code_of(t) for t in spans.tokens(x)], np.uint64).view(np.int64) for x in b["text"]]
                yield pd.DataFrame({"item": b["item"], "codes": codes})

        items = B.bounded_batches(named).select("item", "text").mapInPandas(coded, "item long, codes array<long>").filter("size(codes) > 0")
        self.items = B.materialize(items.join(named.select("item", "item_id"), "item"), "codes")
        size = F.size("codes")
        found = self.items.agg(F.max(size).alias("longest"), F.collect_set(F.when(size < LONGEST, size)).alias("short")).first()
        short = set(found["short"])

        def seeded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for item, codes in zip(b["item"], b["codes"]):
                    own = [window_seeds(np.asarray(codes, np.int64).view(np.uint64), m) for m in masks_for(short & {len(codes)})]
                    yield pd.DataFrame({"h": np.concatenate([h for h, _ in own]).view(np.int64), "item": item, "pos": np.concatenate([at for _, at in own])})

        self.seeds = B.materialize(self.items.select("item", "codes").mapInPandas(seeded, "h long, item long, pos long"), "seeds")
        self.probe = Probe(masks_for(short), found["longest"] or 0, B.BitFilter.of(self.items.select(F.explode("codes").alias("h")).distinct()), B.BitFilter.of(self.seeds.select("h").distinct()))


def runs(codes: np.ndarray) -> tuple[list[int], list[int], np.ndarray]:
    """Starts and lengths of the stretches of codes that are not 0, and those codes."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], codes > 0, [0]))))
    return edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist(), codes[codes > 0]


def on_diagonal(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """Matched tokens, start and end in doc of the span with most of them of which IDENTITY match in place."""
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    if lo >= hi:
        return None
    same = doc[lo + shift : hi + shift] == item[lo:hi]
    height = np.concatenate(([0.0], np.cumsum(same - IDENTITY)))
    count = np.concatenate(([0], np.cumsum(same)))
    lows = np.minimum.accumulate(height)  # the span to j starts best at the first height not above its own
    first = np.searchsorted(-lows, -(height + 1e-9), side="left")
    matched = count - count[np.minimum(first, np.arange(len(height)))]
    end = int(matched.argmax())
    if not matched[end]:
        return None
    start = int(first[end])
    hits = np.flatnonzero(same[start:end])
    return int(matched[end]), lo + shift + start + int(hits[0]), lo + shift + start + int(hits[-1]) + 1


def overlap(doc: np.ndarray, item: np.ndarray, shifts: list[int]) -> tuple[int, int, int] | None:
    """Matched tokens, start and end in doc of the best overlap, if it is enough of the item.

    Best: most matched tokens, then the first. Spans on near diagonals add up where they follow one another.
    """
    n = len(item)
    pieces = sorted({(x[1], x[2], x[0], s) for s in shifts if (x := on_diagonal(doc, item, s))})
    best, chains = None, []
    for start, end, matched, shift in pieces:
        whole, since = matched, start
        if matched >= PIECE:
            for begun, e, s, m, b in reversed(chains):
                if start - begun > n + NEAR:
                    break
                if e <= start and e - s <= start - shift and abs(s - shift) <= NEAR and (m + matched, -b) > (whole, -since):
                    whole, since = m + matched, b
            chains.append((start, end, shift, whole, since))
        if best is None or (whole, -since) > (best[0], -best[1]):
            best = whole, since, end
    if best is None or best[0] < min(n, max(LEAST_TOKENS, min(ENOUGH, LEAST * n))):
        return None
    return best


def found_hits(docs: DataFrame, probe: Probe, id_col: str, text_col: str) -> DataFrame:
    """A row for each document with hits: its id, a key of the row, hits, and the codes about them."""

    def run(texts: list[str | None]) -> tuple[list[int], pd.DataFrame]:
        at, rows = [], []
        for k, (h, pos, codes) in enumerate(probe.hits(texts)):
            if len(h):
                starts, sizes, kept = runs(codes)
                at.append(k)
                rows.append((uuid.uuid4().bytes, h.view(np.int64), pos, starts, sizes, kept.view(np.int64)))
        return at, pd.DataFrame(rows, columns=["row", "hs", "ps", "starts", "sizes", "codes"])

    text = docs.select(F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    return B.materialize(B.beside(text, ["id", "text_key"], ["text"], run, "row binary, hs array<long>, ps array<long>, starts array<long>, sizes array<long>, codes array<long>", 1_000), "hits")


def text_digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def verified(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text_key, item_id, matched, n_tokens, start_token, end_token of each document and item that overlap."""
    bench = Benchmark(benchmark)
    hits = found_hits(docs, bench.probe, id_col, text_col)
    every = hits.select("row", F.explode(F.arrays_zip("hs", "ps")).alias("x")).select("row", F.col("x.hs").alias("h"), F.col("x.ps").alias("p"))
    pairs = seeded_pairs(every, bench.seeds)
    jobs = pairs.groupBy("row", "item").agg(F.collect_set(F.col("p") - F.col("pos")).alias("shifts"))
    jobs = B.lookup_join(jobs, bench.items.withColumnRenamed("codes", "item_codes"), "item", rows=20_000)

    def run(*columns: list) -> tuple[list[int], pd.DataFrame]:
        at, out = [], []
        for k, (item_codes, shifts, starts, sizes, codes) in enumerate(zip(*columns)):
            doc, done = np.zeros(int(starts[-1] + sizes[-1]), np.int64), 0
            for start, size in zip(starts, sizes):
                doc[start : start + size] = codes[done : done + size]
                done += size
            if best := overlap(doc, np.asarray(item_codes, np.int64), shifts):
                at.append(k)
                out.append((best[0], len(item_codes), best[1], best[2]))
        return at, pd.DataFrame(out, columns=["matched", "n_tokens", "start_token", "end_token"])

    rows = jobs.join(hits.select("id", "row", "text_key", "starts", "sizes", "codes"), "row")
    return B.beside(rows, ["id", "text_key", "item_id"], ["item_codes", "shifts", "starts", "sizes", "codes"], run, "matched long, n_tokens long, start_token long, end_token long", 200)


def seeded_pairs(hits: DataFrame, seeds: DataFrame) -> DataFrame:
    """row, p, item, pos: every hit (row, h, p) with every place (h, item, pos) of its seed.

    Where the seeds are too many to broadcast, they are cut into rows of at most PLACES places, which meet the seed's
    hits one by one, and the hits of a seed that many documents hold are spread; no row or task holds all of either.
    """
    if B.small_enough(seeds):
        return hits.join(F.broadcast(seeds), "h")
    numbered = seeds.withColumn("lot", F.pmod(F.xxhash64("item", "pos"), F.lit(1 << 20)))
    sizes = seeds.groupBy("h").agg(F.count("*").alias("n"))
    lots = F.greatest(F.lit(1), F.ceil(F.col("n") / PLACES)).cast("int")
    often = B.skew_join(numbered, sizes, "h", "n", seeds.count()).withColumn("lot", F.pmod("lot", lots).cast("int"))
    places = B.materialize(often.groupBy("h", "lot").agg(F.collect_list(F.struct("item", "pos")).alias("at")), "places")
    met = hits.join(places.select("h").distinct(), "h", "left_semi").groupBy("h").agg(F.count("*").alias("hits"))
    keys = B.materialize(met.join(places.groupBy("h").agg(F.max("lot").alias("last")), "h"), "met")
    own = B.salted_join(hits, keys, ["h"], "row", "hits").select("row", "p", "h", F.explode(F.sequence(F.lit(0), "last")).alias("lot"))
    shared = own.groupBy("h", "lot").agg(F.count("*").alias("n"))
    joined = B.salted_join(own, places.join(shared, ["h", "lot"]), ["h", "lot"], "row", "n")
    return joined.select("row", "p", F.explode("at").alias("at")).select("row", "p", "at.item", "at.pos")


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, matched, n_tokens, start_token, end_token: the best overlap of each document and item.

    An overlap counts if at least half of the item's tokens (8 at least, or all of a shorter item; 50 are enough)
    match in place, three of four in its span; spans of near diagonals that follow one another count together. Of
    overlaps with as many matched tokens the first is given. Items that share an id but not the text count
    apart. Null and empty texts overlap nothing; repeated rows give repeated results; an empty
    benchmark gives none; other columns are ignored. Texts are read once and not shuffled: only hits and the tokens
    about them are.
    """
    found = verified(docs, benchmark, id_col, text_col)
    return found.select(F.col("id").alias(id_col), "item_id", "matched", "n_tokens", "start_token", "end_token")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that overlap no item of the benchmark, with all their columns."""
    found = B.materialize(verified(docs.select(F.lit(0).alias("id"), text_col), benchmark, "id", text_col).groupBy("text_key").agg(F.count("*").alias("n")), "contaminated")
    keyed = docs.select(F.struct("*").alias("doc"), text_digest(F.col(text_col)).alias("text_key"))
    return B.anti_join(keyed, found, "text_key", KEYS).select("doc.*")
