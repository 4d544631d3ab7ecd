"""Cosine top-K, per-domain quotas with backfill, genre-centroid recommendations."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import vectors as V
from .bipartite import to_tall
from .relational import kept_rows, ordered_string_agg, top_k
from .users import genre_centroids, global_mean, user_genres

#: Items of a block, and users that meet it in one group.
BLOCK_ROWS = 8_192
#: Items that the blocks' centres are drawn from, and centres at most.
SAMPLE, MOST_BALLS = 20_000, 4_096
#: Scores or bounds that a task has in memory at a time, and rows with a vector that it hands on at a time.
CELLS, ROWS_OUT = 1_000_000, 2_048
QUOTA = {"AV": 3, "GAME": 3, "WEBNOVEL": 3}
SCORED = "user_id long, content_id long, domain string, score double"


def matrix_of(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows, from the column's own memory; a missing element is nan."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    if not len(lists):
        return np.empty((0, 0))
    dims = pc.unique(pc.list_value_length(lists)).to_pylist()
    if len(dims) > 1 or dims[0] is None:
        raise ValueError(f"vectors need one length, these have {dims[:5]}")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(lists), dims[0])


def unit_rows(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    m = matrix_of(vectors)
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + V.TINY)


def sliced(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows that a row's `width` numbers make about CELLS in all."""
    most = max(1, CELLS // max(1, width))
    for b in batches:
        for lo in range(0, b.num_rows, most):
            yield b.slice(lo, most)


class BallIndex:
    """Blocks of items about centres: for each block its lane, centre, part, and the widest angle of its items from the centre."""

    def __init__(self, keys: np.ndarray, centres: np.ndarray, least_cos: np.ndarray):
        self.keys, self.centres = keys, centres  # keys: rows (lane, ball, sub), sorted
        self.angle = np.arccos(np.clip(least_cos - 1e-12, -1, 1))

    def bounds(self, unit: np.ndarray) -> np.ndarray:
        """For each vector and block a number that no cosine with the block's items exceeds."""
        about = np.arccos(np.clip(unit @ self.centres.T, -1, 1))[:, self.keys[:, 1]]
        return np.where(np.linalg.norm(unit, axis=1)[:, None] > 0.5, np.cos(np.maximum(0, about - self.angle - 1e-9)), 1.0) + 1e-12

    def visits(self, unit: np.ndarray, least: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and blocks of those from the lo-th to the hi-th of each lane, by falling bound, whose bound reaches `least` of the lane."""
        bound, found = self.bounds(unit), []
        for lane in np.unique(self.keys[:, 0]):
            own = np.flatnonzero(self.keys[:, 0] == lane)
            order = own[np.argsort(-bound[:, own], axis=1, kind="stable")[:, lo:hi]]
            row, col = np.nonzero(np.take_along_axis(bound, order, axis=1) >= least[:, [lane]])
            found.append((row, order[row, col]))
        return tuple(np.concatenate([f[k] for f in found]) for k in (0, 1))


def ball_index(items: DataFrame, lane: Column) -> tuple[DataFrame, BallIndex | None]:
    """The items with their block (lane, ball, sub), and the index; (content_id, domain, vector) with vectors of one length.

    Centres come from at most SAMPLE items, drawn by a hash of the id; every item is placed by its nearest centre, and
    a ball with more than BLOCK_ROWS items is dealt into several blocks. A lane is a domain with a quota, or the rest.
    """
    n = items.count()
    if not n:
        return items.select("*", *(F.lit(0).alias(c) for c in ("lane", "ball", "sub"))), None
    sample = unit_rows(items.orderBy(F.xxhash64("content_id")).limit(SAMPLE).select("vector").toArrow()["vector"])
    centres = sample[np.random.default_rng(1).permutation(len(sample))[: min(MOST_BALLS, -(-n // BLOCK_ROWS))]]
    for _ in range(8):
        at = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, len(centres)):
            unit = unit_rows(b["vector"])
            cos = unit @ centres.T
            ball = cos.argmax(axis=1)
            flat = np.linalg.norm(unit, axis=1) < 0.5  # a vector of length 0 has no direction
            own = np.where(flat, -1.0, cos[np.arange(len(ball)), ball])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ball.astype(np.int32)), pa.array(own)], names=[*b.schema.names, "ball", "cos"])

    placed = kept_rows(items.select("content_id", "domain", "vector", lane.cast("int").alias("lane")).mapInArrow(place, "content_id long, domain string, vector array<double>, lane int, ball int, cos double"))
    subs = placed.groupBy("lane", "ball").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("subs"))
    placed = placed.join(F.broadcast(subs), ["lane", "ball"]).withColumn("sub", F.pmod(F.xxhash64("content_id"), F.col("subs")).cast("int")).drop("subs")  # a row for each ball and lane
    found = placed.groupBy("lane", "ball", "sub").agg(F.min("cos").alias("cos")).orderBy("lane", "ball", "sub").collect()
    return placed.drop("cos"), BallIndex(np.array([r[:3] for r in found], np.int64), centres, np.array([r["cos"] for r in found]))


def best_items(users: DataFrame, items: DataFrame, k: int, quota: Mapping[str, int] | None = None, digits: int = 9, counted: list[int] | None = None) -> DataFrame:
    """(user_id, content_id, domain, score): a superset of each user's picks, exact, by blocks of near items.

    A user goes to the block with the best bound first, of each domain with a quota, then to a few more, then to all others
    whose bound reaches the k-th score found (or the domain's last one); the others cannot hold a pick. Users meet a
    block in groups of about BLOCK_ROWS, only the k best of a block, and the best of each quota domain, leave it,
    and the driver sees the blocks' centres and angles only. Scores are rounded so that ties go to the smaller id.
    `counted` gets the pairs scored and all pairs.
    """
    groups = {d: n for d, n in (quota or {}).items() if n > 0}
    domain = F.col("domain") if "domain" in items.columns else F.lit(None).cast("string")
    lanes = {d: i for i, d in enumerate(groups)}
    lane = F.coalesce(*(F.when(domain == d, i) for d, i in lanes.items()), F.lit(len(lanes)))
    users = kept_rows(users.select("user_id", V.as_vector(F.col("vector")).alias("vector")))
    placed, index = ball_index(kept_rows(items.select("content_id", domain.alias("domain"), V.as_vector(F.col("vector")).alias("vector"))), lane)
    empty = users.select("user_id", F.lit(0).cast("long").alias("content_id"), F.lit("").alias("domain"), F.lit(0.0).alias("score")).limit(0)
    if index is None:
        return empty
    most = int(np.bincount(index.keys[:, 0]).max())
    found, turns = None, [t for t in ((0, 1), (1, 5), (5, most)) if t[0] < most]
    for lo, hi in turns:
        none = F.array(*[F.lit(-2.0)] * (len(lanes) + 1)).alias("least")
        asked = users.select("*", none) if found is None else users.join(reached(found, k, groups, digits), "user_id", "left").withColumn("least", F.coalesce("least", none))

        def route(batches: Iterator[pa.RecordBatch], lo: int = lo, hi: int = hi) -> Iterator[pa.RecordBatch]:
            for b in sliced(batches, len(index.keys)):
                row, at = index.visits(unit_rows(b["vector"]), matrix_of(b["least"]), lo, hi)
                own = b.select(["user_id", "vector"])
                for k in range(0, len(row), ROWS_OUT):
                    keys = index.keys[at[k : k + ROWS_OUT]].astype(np.int32)
                    some = own.take(pa.array(row[k : k + ROWS_OUT]))
                    yield pa.RecordBatch.from_arrays([*some.columns, *(pa.array(keys[:, i]) for i in range(3))], names=["user_id", "vector", "lane", "ball", "sub"])

        routed = kept_rows(asked.mapInArrow(route, "user_id long, vector array<double>, lane int, ball int, sub int"))
        new = scored_cells(routed, placed, k, groups, digits, counted)
        found = new if found is None else found.unionByName(new)
        found = kept_rows(found) if (lo, hi) != turns[-1] else found
    if counted is not None:
        counted.append(users.count() * placed.count())
    return found


def best_places(s: np.ndarray, idx: np.ndarray, n: int) -> np.ndarray:
    """Places in s, row by row, of the n largest of each row's columns idx, which ascend; ties go to the smaller column."""
    mine = s[:, idx]
    if mine.shape[1] > n:
        least = np.partition(mine, mine.shape[1] - n, axis=1)[:, mine.shape[1] - n]
        row, col = np.nonzero(mine >= least[:, None])
    else:
        row, col = (x.ravel() for x in np.indices(mine.shape))
    order = np.lexsort((col, -mine[row, col], row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, np.arange(len(s)))
    kept = np.arange(len(row)) - first[row] < n
    return row[kept] * s.shape[1] + idx[col[kept]]


def reached(found: DataFrame, k: int, groups: Mapping[str, int], digits: int) -> DataFrame:
    """(user_id, least): for each lane the score below which a further item is no pick; of `found`, the candidates so far."""
    nth = lambda scores, n: F.coalesce(F.get(F.sort_array(scores, False), F.lit(n - 1)), F.lit(-2.0))
    last = nth(F.collect_list("score"), k)
    of = [nth(F.collect_list(F.when(F.col("domain") == d, F.col("score"))), n) for d, n in groups.items()]
    return found.groupBy("user_id").agg(F.transform(F.array(*(F.least(last, x) for x in of), last), lambda x: x - 10.0**-digits).alias("least"))


def scored_cells(routed: DataFrame, placed: DataFrame, k: int, groups: Mapping[str, int], digits: int, counted: list[int] | None) -> DataFrame:
    """The best items of every block that a user was sent to; a block that many users visit meets them in groups."""
    key = ["lane", "ball", "sub"]
    parts = kept_rows(routed.groupBy(key).agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / BLOCK_ROWS).cast("int")))  # a row a block
    if counted is not None:
        sizes = placed.groupBy(key).agg(F.count("*").alias("m"))
        counted.append(parts.join(sizes, key).agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0)
    near = F.broadcast(parts.select(*key, "parts"))
    left = routed.join(near, key).withColumn("part", F.pmod(F.xxhash64("user_id"), F.col("parts")).cast("int")).drop("parts")
    right = placed.join(near, key).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def score(people: pa.Table, own: pa.Table) -> pa.Table:
        own = own.select(["content_id", "domain", "vector"]).sort_by("content_id") if people.num_rows else own.slice(0, 0)
        names, matrix = own["domain"].to_numpy(), unit_rows(own["vector"])
        own = own.select(["content_id", "domain"])
        wanted = [(np.arange(len(names)), k)] + [(np.nonzero(names == d)[0], n) for d, n in groups.items()]
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        most = max(1, CELLS // max(1, len(names)))
        for lo in range(0, people.num_rows if len(names) else 0, most):
            s = np.round(unit_rows(people["vector"].slice(lo, most)) @ matrix.T, digits)
            picked = np.unique(np.concatenate([best_places(s, idx, n) for idx, n in wanted]))
            user, item = np.divmod(picked, len(names))
            found.append((user + lo, item, s[user, item]))
        user, item, scores = (np.concatenate(x) for x in zip(*found))
        return pa.table({"user_id": people["user_id"].take(pa.array(user)), "content_id": own["content_id"].take(pa.array(item)), "domain": own["domain"].take(pa.array(item)), "score": pa.array(scores)})

    cell = [*key, "part"]
    return left.groupBy(cell).cogroup(right.groupBy(cell)).applyInArrow(score, SCORED)


def topk_cosine(users: DataFrame, items: DataFrame, k: int = 5, digits: int = 9) -> DataFrame:
    """(user_id, rank, content_id, score)."""
    found = best_items(users, items, k, digits=digits)
    return top_k(found, ["user_id"], k, F.desc("score"), F.col("content_id")).select("user_id", "rank", "content_id", "score")


def first_order(order: str | None) -> Column:
    """The rows' order as `__at`: an order column, else as they are read."""
    return (F.col(order) if order else F.monotonically_increasing_id()).alias("__at")


def with_meta(recs: DataFrame, contents: DataFrame, users: DataFrame | None = None, prefs: DataFrame | None = None, order: str | None = None, contents_order: str | None = None) -> DataFrame:
    """Recommendations with title and domain of the content and the cleaned username.

    Of a repeated content the first row counts, by `contents_order`, of a user the first name by `order`; without an order column
    as they are read.
    """
    title = C.resolve_column(contents, C.CONTENT_NAME)
    rows = contents.select(C.to_bigint(F.col("content_id")).alias("content_id"), F.struct(F.col(f"`{title}`").alias("t") if title else F.lit("").alias("t"), "domain").alias("m"), first_order(contents_order))
    meta = rows.groupBy("content_id").agg(F.min_by("m", "__at").alias("m"))
    out = recs.join(meta, "content_id", "left").select(*recs.columns, F.col("m.t").alias("master_title"), F.col("m.domain").alias("domain"))
    if users is not None:
        name = users.select("user_id", "username", first_order(order))
        if prefs is not None:
            own = prefs.select("*", first_order(order)).groupBy(C.to_bigint(F.col("id")).alias("user_id")).agg(F.min_by("username", "__at").alias("__p"))
            name = name.join(own, "user_id", "left").select("user_id", "__at", C.clean_username(F.col("username"), F.col("__p")).alias("username"))
        else:
            name = name.select("user_id", "__at", C.clean_username(F.col("username")).alias("username"))
        out = out.join(name.groupBy("user_id").agg(F.min_by("username", "__at").alias("username")), "user_id", "left")
    return out


def titled(contents: DataFrame, order: str | None = None) -> DataFrame:
    """(content_id, domain, content_title) of contents with a title that is neither null nor blank; of a repeated one the last row, by `order` or as they are read."""
    title = C.resolve_column(contents, C.TITLE, required=True)
    rows = contents.select(C.to_bigint(F.col("content_id")).alias("content_id"), "domain", C.blank_to_null(F.col(f"`{title}`")).alias("content_title"), first_order(order)).filter("content_id is not null and content_title is not null")
    return rows.groupBy("content_id").agg(F.max_by(F.struct("domain", "content_title"), "__at").alias("m")).select("content_id", "m.domain", "m.content_title")


def domain_quota(users: DataFrame, items: DataFrame, contents: DataFrame, quota: Mapping[str, int] = QUOTA, fill: bool = True, order: str | None = None) -> DataFrame:
    """(user_id, rank, content_id, content_title, score, domain).

    Each domain's best up to its quota, then, where a domain fell short, the best of what is left from any
    domain. Contents without a title are no candidates.
    """
    own = kept_rows(titled(contents, order))
    catalogue = items.join(own.select("content_id", "domain"), "content_id")
    total = sum(max(0, n) for n in quota.values())
    found = best_items(users, catalogue, total, quota)
    need = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in quota.items() for x in kv)), F.col("domain")), F.lit(0))
    by = [F.desc("score"), F.col("content_id")]
    # The best `total` overall and each domain's best cover whatever quota and backfill can pick.
    ranked = found.withColumn("d", F.row_number().over(Window.partitionBy("user_id", "domain").orderBy(*by))).withColumn("picked", (F.col("d") <= need).cast("int"))
    filled = ranked.withColumn("n", F.sum("picked").over(Window.partitionBy("user_id"))).withColumn("r", F.row_number().over(Window.partitionBy("user_id", "picked").orderBy(*by)))
    chosen = filled.filter((F.col("picked") == 1) | (F.col("r") <= total - F.col("n"))) if fill else filled.filter("picked = 1")
    out = chosen.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(*by)))
    return out.join(own.select("content_id", "content_title"), "content_id", "left").select("user_id", "rank", "content_id", "content_title", "score", "domain")


def recent_ids(contents: DataFrame, min_year: int = 2020, col: str = "created_at") -> DataFrame | None:
    """content_id of contents created from min_year on; null dates and unparsable ones are out, no column means no filter."""
    if col not in contents.columns:
        return None
    when = F.try_to_timestamp(F.col(col).cast("string"))
    return contents.filter(F.year(when) >= min_year).select(C.to_bigint(F.col("content_id")).alias("content_id")).filter("content_id is not null").distinct()


def genre_topk(items: DataFrame, genres: DataFrame, prefs: DataFrame, dim: int, k: int = 5, allowed: DataFrame | None = None, digits: int = 9) -> DataFrame:
    """(user_id, rank, content_id, score) from genre centroids; users without a known genre get the items' mean.

    Only items with a genre are candidates; `allowed` narrows the genre table first, and a ValueError says that it
    leaves none.
    """
    if allowed is not None:
        genres = genres.join(allowed, "content_id", "left_semi")
        if not genres.limit(1).count():
            raise ValueError("no content that is recent enough has a genre")
    items = items.join(genres.select(C.to_bigint(F.col("content_id")).alias("content_id")).distinct(), "content_id", "left_semi")
    rows = user_genres(prefs, genres).select("user_id", "genre").distinct()
    known = V.mean_vector(rows.join(genre_centroids(items, genres, dim), "genre"), ["user_id"], "vector", dim)
    users = rows.select("user_id").distinct().join(known, "user_id", "left").crossJoin(F.broadcast(global_mean(items, dim).withColumnRenamed("vector", "mean")))
    return topk_cosine(users.select("user_id", F.coalesce("vector", "mean").alias("vector")), items, k, digits)


def genre_lists(genres: DataFrame, order: str | None = None) -> DataFrame:
    """(content_id, genres_str): a content's distinct genres joined by bars, in order of `order` or else of their names."""
    typed = genres.withColumn("content_id", C.to_bigint(F.col("content_id"))).filter("content_id is not null")
    tall = typed.select("content_id", C.blank_to_null(F.col("raw_genre")).alias("raw_genre"), order).filter("raw_genre is not null") if order else to_tall(typed)
    return ordered_string_agg(tall, ["content_id"], "raw_genre", order or "raw_genre", "genres_str")


def genre_recommendations(items: DataFrame, genres: DataFrame, prefs: DataFrame, contents: DataFrame, dim: int, k: int = 5, allowed: DataFrame | None = None, digits: int = 9, order: str | None = None) -> DataFrame:
    """genre_topk with names: user_id, username, rank, content_id, content_name, domain, genres_str, score.

    Of a user's rows the first one's username counts, by `order` or as they are read. Contents and genres that are
    not known leave nulls.
    """
    found = genre_topk(items, genres, prefs, dim, k, allowed, digits)
    if allowed is not None:
        genres = genres.join(allowed, "content_id", "left_semi")
    people = user_genres(prefs.withColumn("__at", first_order(order)), genres, keep="__at").groupBy("user_id").agg(F.min_by("username", "__at").alias("username"))
    named = with_meta(found, contents).withColumnRenamed("master_title", "content_name")
    out = named.join(people, "user_id", "left").join(genre_lists(genres), "content_id", "left")
    return out.select("user_id", "username", "rank", "content_id", "content_name", "domain", "genres_str", "score")
