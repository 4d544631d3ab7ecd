"""Near-duplicate documents by MinHash bands, odd sketches and exact confirmation.

Equal shingle sets collapse into one node, which has a number of its own, so that null and repeated ids link as
others do. Nodes whose MinHash samples agree in a band are candidates;
the parities of the samples, folded into a bitmap, estimate their similarity, and clearly lower ones
go. Each bucket first links its members to its smallest node, so a group of copies costs its size and
not its square; members that this leaves outside the bucket's main component are then held in memory, in bounded
parts, while the bucket's other members stream past them, and only links between components come out.
Every link is confirmed on full shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _base as B

BANDS, ROWS, BITS = 24, 5, 512
SAMPLES = BANDS * ROWS
#: The bands miss a pair at this similarity once in 14,000, and one at 85 % once in a million.
LEAST_PERCENT = 80
MEMO_WORDS = 200_000
#: Members of one leader that one task compares at most, give or take chance.
LEADER_PART = 250
#: Shingles of a bucket's outsiders that one task holds, give or take one document and chance.
HELD_SHINGLES = 1_000_000
#: Members of a bucket that stream past one task's outsiders, give or take chance.
STREAM_PART = 500
#: Parts or streams of one lot of a node's jobs, and bytes of sets that a task sends at a time, give or take a lot.
LOT, SHOWN_BYTES = 64, 16 << 20
#: Documents whose comparisons are broadcast to the scan of the texts; more of them are shuffled.
JOB_ROWS = 50_000

_rng = np.random.default_rng(20)
_FACTOR = _rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, 5, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_memo: dict[bytes, int] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of the 5-word shingles of each text, A-Z lower-cased.

    Fewer words make one shingle; a text without words has none.
    """
    global _memo
    split = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    new = set(chain.from_iterable(split)).difference(_memo)
    if len(_memo) + len(new) > MEMO_WORDS:
        _memo = {}
        new = set(chain.from_iterable(split))
    _memo.update((w, xxhash.xxh64_intdigest(w)) for w in new)
    get = _memo.__getitem__
    for words in split:
        n = len(words)
        h = np.fromiter(map(get, words), np.uint64, n)
        if not n:
            yield h
        elif n < 5:
            yield mixed(np.array([xxhash.xxh64_intdigest(h.tobytes(), seed=n)], np.uint64))
        else:
            s = np.zeros(n - 4, np.uint64)
            for k in range(5):
                s += h[k : n - 4 + k] * _PLACE[k]
            yield np.unique(mixed(s))


def minhash(shingles: np.ndarray) -> np.ndarray:
    best = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(shingles), 1_000):
        best = np.minimum(best, (shingles[None, lo : lo + 1_000] * _FACTOR[:, None]).min(axis=1))
    return best


def band_keys(samples: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = mixed(key * np.uint64(31) + samples.reshape(BANDS, ROWS)[:, k])
    return key.view(np.int64)


def odd_sketch(samples: np.ndarray) -> bytes:
    """Parity of the samples that fall on each bit."""
    spot = mixed(samples + np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(BITS)
    return np.packbits((np.bincount(spot.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).tobytes()


def estimate(differing_bits: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the number of bits in which two odd sketches differ."""
    u = np.minimum(differing_bits, BITS / 2 - 1)
    return 1 + BITS / (4 * SAMPLES) * np.log(1 - 2 * u / BITS)


def least_size(percent: int) -> int:
    """Sets below this size reach the threshold only if they are equal."""
    return -(-percent // max(1, 100 - percent))


def least_estimate(percent: int) -> float:
    """Estimates below this are over five standard errors under the threshold: 0.034 each at 85 %, 0.040 at 80 %."""
    return percent / 100 - (0.2 if percent >= 85 else 0.22)


def sketch(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, row_key, digest of the shingle set (null if empty), n_shingles, bands and odd sketch (null below least_size)."""
    least = least_size(percent)

    def sketched(texts: list[str | None]) -> tuple[None, pd.DataFrame]:
        rows = []
        for s in shingle_sets(texts):
            m = minhash(s) if len(s) >= least else None
            rows.append((hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None, len(s), None if m is None else band_keys(m), None if m is None else odd_sketch(m)))
        return None, pd.DataFrame(rows, columns=["digest", "n_shingles", "bands", "odd"])

    return B.beside(docs, ["doc_id", "row_key"], ["text"], sketched, "digest binary, n_shingles long, bands array<long>, odd binary", 400)


def differing(a: pd.Series, b: pd.Series) -> np.ndarray:
    x = np.frombuffer(b"".join(a), np.uint8) ^ np.frombuffer(b"".join(b), np.uint8)
    return np.unpackbits(x).reshape(-1, BITS).sum(axis=1)


def promising(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs a < b whose sizes allow a link and whose odd sketches do not rule it out."""
    own = nodes.select("node", "n_shingles", "odd")
    both = pairs.join(own.toDF("a", "na", "odd_a"), "a").join(own.toDF("b", "nb", "odd_b"), "b")
    both = both.filter((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))
    least = least_estimate(percent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if len(p):
                yield p.loc[estimate(differing(p["odd_a"], p["odd_b"])) >= least, ["a", "b"]]

    return both.mapInPandas(run, "a long, b long")


def packed(shingles: np.ndarray) -> bytes:
    """48 bits of each hash; two sets of a thousand disagree by chance once in 10^8."""
    return shingles.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def shown(docs: DataFrame, sets: DataFrame, jobs: DataFrame, fields: str) -> DataFrame:
    """The packed shingle set of every node in `jobs`, for each of its jobs (structs of `fields`).

    A node's set is taken from any row with its row key; each task shows it once a lot. Lots bound a node's list of jobs.
    """
    listed = jobs.groupBy("node", "lot").agg(F.collect_list("job").alias("jobs")).join(sets.select("node", "row_key", "n"), "node")
    listed = B.materialize(listed, "jobs")
    if B.small_enough(listed, JOB_ROWS):
        texts = docs.join(F.broadcast(listed), "row_key")
    else:
        texts = B.skew_join(docs, listed, "row_key", "n", sets.agg(F.sum("n")).first()[0])
    names = [f.split()[0] for f in fields.split(", ")]

    def show(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: set[tuple[int, int]] = set()
        for x in batches:
            x = x[[k not in done for k in zip(x["node"], x["lot"])]].drop_duplicates(["node", "lot"])
            done.update(zip(x["node"], x["lot"]))
            rows, held = [], 0
            for lo in range(0, len(x), 200):
                own = x.iloc[lo : lo + 200]
                for i, s, todo in zip(own["node"], shingle_sets(own["text"].tolist()), own["jobs"]):
                    raw = packed(s)
                    rows += [(*(j[n] for n in names), i, raw) for j in todo]
                    held += len(raw) * len(todo)
                    if held > SHOWN_BYTES:
                        yield pd.DataFrame(rows, columns=[*names, "node", "set"])
                        rows, held = [], 0
            yield pd.DataFrame(rows, columns=[*names, "node", "set"])

    return texts.select("node", "lot", "text", "jobs").mapInPandas(show, f"{fields}, node long, set binary")


def confirmed(pairs: DataFrame, docs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs whose full sets reach the threshold.

    A leader's set is sent once to each part of its members, which stream past it.
    """
    leaders = pairs.groupBy("a").agg(F.count("*").alias("n"), F.ceil(F.count("*") / LEADER_PART).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")
    lot = F.floor(F.col("part") / LOT).cast("int").alias("lot")
    lead = leaders.select(F.col("a").alias("node"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a"), F.lit(True).alias("lead"))
    led = B.skew_join(pairs, leaders, "a", "n", pairs.count())
    jobs = lead.unionByName(led.select(F.col("b").alias("node"), part.alias("part"), "a", F.lit(False).alias("lead")))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, None
        for x in batches:
            out = []
            for a, p, is_lead, b, raw in zip(x["a"], x["part"], x["lead"], x["node"], x["set"]):
                if is_lead:
                    at, held = (a, p), unpacked(raw)
                elif at == (a, p):
                    own = unpacked(raw)
                    if len(own) and len(held):
                        slot = np.minimum(np.searchsorted(held, own), len(held) - 1)
                        same = int((held[slot] == own).sum())
                        if 100 * same >= percent * (len(held) + len(own) - same):
                            out.append((a, b))
            yield pd.DataFrame(out, columns=["a", "b"])

    rows = shown(docs, sets, jobs.select("node", lot, F.struct("a", "part", "lead").alias("job")), "a long, part int, lead boolean")
    return rows.repartition("a", "part").sortWithinPartitions("a", "part", F.desc("lead")).mapInPandas(compare, "a long, b long").distinct()


class Held:
    """Shingle sets of a bucket's outsiders, by shingle, and which components the links found so far have joined."""

    def __init__(self, rows: list[tuple[int, int, np.ndarray]]):
        self.nodes, self.roots = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
        self.joined: dict[int, int] = {}
        self.sizes = np.array([len(r[2]) for r in rows], np.int64)
        every = np.concatenate([r[2] for r in rows])
        order = np.argsort(every, kind="stable")
        self.who = np.repeat(np.arange(len(rows)), self.sizes)[order]
        self.keys, self.starts = np.unique(every[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(every))

    def links(self, node: int, component: int, shingles: np.ndarray, percent: int) -> list[tuple[int, int]]:
        """One link of the node to each component that it reaches and that no earlier link has joined to its own.

        All links of a group so make a forest of its components: fewer rows than components, whatever the pairs.
        """
        while component in self.joined:
            component = self.joined[component]
        slot = np.minimum(np.searchsorted(self.keys, shingles), len(self.keys) - 1)
        slot = slot[self.keys[slot] == shingles]
        n = self.ends[slot] - self.starts[slot]
        spot = np.repeat(self.starts[slot] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        same = np.bincount(self.who[spot], minlength=len(self.nodes))
        hit = np.nonzero((100 * same >= percent * (self.sizes + len(shingles) - same)) & (self.roots != component))[0]
        reached, first = np.unique(self.roots[hit], return_index=True)
        self.roots[np.isin(self.roots, reached)] = component
        self.joined.update(dict.fromkeys(reached.tolist(), component))
        return [(min(node, x), max(node, x)) for x in self.nodes[hit[first]].tolist()]


def across(placed: DataFrame, docs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the components of a bucket: its outsiders against all its other members.

    placed: band, key, node, n_shingles, component. Buckets of one component need nothing. The outsiders are cut into
    parts of HELD_SHINGLES and the members into streams of STREAM_PART; each part meets each stream in one group. The
    work grows with outsiders times members of a bucket; rows sent grow with its members for each part of its
    outsiders, and a group returns fewer rows than it has components.
    """
    split = placed.groupBy("band", "key", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    main = F.max_by(F.struct("component", "w"), F.struct("n", -F.col("component")))
    buckets = split.groupBy("band", "key").agg(main.alias("main"), F.sum("w").alias("w"), F.sum("n").alias("n"), F.count("*").alias("k")).filter("k > 1")
    buckets = B.materialize(buckets.select("band", "key", "n", F.col("main.component").alias("main"), F.ceil((F.col("w") - F.col("main.w")) / HELD_SHINGLES).cast("int").alias("parts"), F.ceil(F.col("n") / STREAM_PART).cast("int").alias("streams")), "buckets")
    rest = B.materialize(B.salted_join(placed, buckets, ["band", "key"], "node", "n"), "mixed")
    dealt = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    held = rest.filter("component != main").select("*", dealt("parts", 1).alias("part"), F.explode(every("streams")).alias("stream"), F.lit(True).alias("held"))
    passing = rest.select("*", F.explode(every("parts")).alias("part"), dealt("streams", 2).alias("stream"), F.lit(False).alias("held"))
    passing = passing.filter((F.col("component") == F.col("main")) | (dealt("parts", 1) != F.col("part")))
    lot = F.floor(F.when(F.col("held"), F.col("stream")).otherwise(F.col("part")) / LOT).cast("int").alias("lot")
    jobs = held.unionByName(passing).select("node", lot, F.struct("band", "key", "part", "stream", "component", "held").alias("job"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, rows, held, last = (0, 0, 0, 0), [], None, None

        def complete() -> list[tuple[int, int]]:
            """Once a group's outsiders are there, the links among them, which its first stream reports."""
            nonlocal held
            if held or not rows:
                return []
            held = Held(rows)
            return [link for r in rows for link in held.links(*r, percent)] if at[3] == 0 else []

        for x in batches:
            out: set[tuple[int, int]] = set()
            for band, key, part, stream, component, is_held, node, raw in zip(x["band"], x["key"], x["part"], x["stream"], x["component"], x["held"], x["node"], x["set"]):
                if at != (band, key, part, stream):
                    out.update(complete())
                    at, rows, held, last = (band, key, part, stream), [], None, None
                if last == node:  # another task showed it, too
                    continue
                last = node
                if is_held:
                    rows.append((node, component, unpacked(raw)))
                elif rows:
                    out.update(complete())
                    out.update(held.links(node, component, unpacked(raw), percent))
            yield pd.DataFrame(sorted(out), columns=["a", "b"])
        yield pd.DataFrame(sorted(complete()), columns=["a", "b"])

    found = shown(docs, sets, jobs, "band int, key long, part int, stream int, component long, held boolean")
    return found.repartition("band", "key", "part", "stream").sortWithinPartitions("band", "key", "part", "stream", F.desc("held"), "node").mapInPandas(compare, "a long, b long").distinct()


def hot_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left joined to a table with one row a key, whatever part of left a key holds."""
    if B.small_enough(right):
        return left.join(F.broadcast(right), key)
    often = left.groupBy(key).agg(F.count("*").alias("__n"))
    return B.skew_join(left, right.join(often, key), key, "__n", left.count()).drop("__n")


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of the nodes that have a link.

    Labels fall to the smallest one among the neighbours' and then jump to their own label's label, so
    the rounds grow with the logarithm of the longest path. A hub's row is sent to its leaves, never they to it.
    """
    both = B.materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    label = B.materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = hot_join(both, label.toDF("b", "other"), "b").groupBy("a").agg(F.min("other").alias("other"))
        low = label.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("component", "other").alias("mid"), F.col("component").alias("old"))
        jump = hot_join(low, label.toDF("mid", "next"), "mid").select("node", F.least("mid", "next").alias("component"), "old")
        new = B.materialize(jump, "labels")
        if not new.filter("component != old").limit(1).count():
            return new.select("node", "component")
        label = new.select("node", "component")


def row_key(doc_id: Column, text: Column) -> Column:
    """Digest of a row's id and text; rows that agree in both are one row's copies."""
    return F.unhex(F.md5(F.concat_ws("\u0000", F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))).cast("binary")))


def grouped(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, row_key, n_shingles, component_id and the component's number (null without words) of every row of (doc_id, text)."""
    if percent < LEAST_PERCENT:
        raise ValueError(f"the bands are set for a similarity of {LEAST_PERCENT} % or more")
    docs = B.bounded_batches(docs).withColumn("row_key", row_key(F.col("doc_id"), F.col("text")))
    made = B.materialize(sketch(docs, percent), "sketches")
    one = made.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("row_key", "n_shingles", "bands", "odd")))
    sets = B.materialize(one.withColumn("node", F.monotonically_increasing_id()), "sets")
    nodes = sets.filter("bands is not null").select("node", "n_shingles", "bands", "odd")
    spread = nodes.select("node", "n_shingles", F.posexplode("bands").alias("band", "key"))
    shared = B.materialize(spread.groupBy("band", "key").agg(F.min("node").alias("a"), F.count("*").alias("n")).filter("n > 1"), "shared")
    members = B.materialize(B.salted_join(spread, shared, ["band", "key"], "node", "n").drop("n"), "members")
    stars = B.materialize(promising(members.filter("a < node").select("a", F.col("node").alias("b")).distinct(), nodes, percent), "stars")
    texts = docs.select("row_key", "text")
    links = B.materialize(confirmed(stars, texts, sets, percent), "star-links")
    label = components(links)

    placed = members.join(label, "node", "left").select("band", "key", "node", "n_shingles", F.coalesce("component", "node").alias("component"))
    more = B.materialize(across(placed, texts, sets, percent), "more-links")
    if more.limit(1).count():
        label = components(links.unionByName(more))

    own = label.join(sets.select("node", "least"), "node")
    names = own.groupBy("component").agg(F.min("least").alias("component_id"))
    named = sets.join(hot_join(own.select("node", "component"), names, "component"), "node", "left")
    named = named.select("digest", "n", F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("component", "node").alias("component"))
    full = made.filter("digest is not null").select("doc_id", "row_key", "digest", "n_shingles")
    out = B.skew_join(full, named, "digest", "n", made.count()).select("doc_id", "row_key", "n_shingles", "component_id", "component")
    empty = made.filter("digest is null").select("doc_id", "row_key", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component"))
    return out.unionByName(empty)


def group(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for every input row.

    Documents link if 100 * intersection >= percent * union of their shingle sets. A null or empty text has
    an empty set and links with nothing. Repeated rows and copies share a component and keep their rows, and rows that
    share an id are grouped by their own texts; a null id links as others do but never names a component, so a
    component of null ids has a null component_id and is not kept. Ties do not arise: the smallest id wins. Other
    columns are ignored.
    """
    found = grouped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), percent)
    return found.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One document of each group, with all its columns: that of the smallest id, null ids last, then of the smallest digest.

    Rows that share an id are documents of their own unless their texts group them. Of rows without words, those of
    one id are one document, and those without an id stay. Of rows that agree in id and text one stays.
    """
    found = B.materialize(grouped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), percent), "grouped")
    wordless = F.col("component").isNull()
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key").alias("order")
    best = found.filter(~wordless).groupBy("component").agg(F.min(order).alias("best"))
    rows = hot_join(found.filter(~wordless), best, "component").select("row_key", (F.col("row_key") == F.col("best.row_key")).alias("stays"))
    blank = found.filter(wordless & F.col("doc_id").isNotNull())
    first = blank.groupBy("doc_id").agg(F.min("row_key").alias("best"))
    rows = rows.unionByName(hot_join(blank, first, "doc_id").select("row_key", (F.col("row_key") == F.col("best")).alias("stays")))
    counted = B.materialize(rows.groupBy("row_key").agg(F.first("stays").alias("stays"), F.count("*").alias("n")).filter("not stays or n > 1"), "decided")
    keyed = docs.withColumn("__row_key", row_key(F.col("doc_id").cast("long"), F.col("text")))
    named = counted.withColumnRenamed("row_key", "__row_key")
    left = B.anti_join(keyed, named.select("__row_key", "n"), "__row_key")
    twice = named.filter("stays")
    if twice.limit(1).count():
        left = left.unionByName(hot_join(keyed, twice.select("__row_key"), "__row_key").dropDuplicates(["__row_key"]))
    return left.select(*docs.columns)
