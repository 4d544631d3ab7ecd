"""Exact dedup by content-defined chunk recipes.

A text's bytes are cut where a hash of the last eight bytes says so, so equal stretches give equal chunks wherever they
stand. A recipe is the ordered list of a text's chunk identifiers. Identifiers are digests that are verified: every
chunk of a recipe met more than once is compared byte by byte with all others of its digest, each distinct chunk
moving once a task, and texts are equal when their lists are. Texts whose recipe is met once move nowhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _base as B

WINDOW = 8
LEAST, MOST = 2_048, 65_536
#: Bits of a window's hash that are zero at a cut: a cut every 4 kB beyond the least size.
CUT_BITS = 12
#: Bytes of chunks that a task remembers having sent.
SENT_BYTES = 32 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def digest_128(chunk: bytes) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


def digest_512(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk).digest()


#: Tried in turn; the next one is needed only if two different chunks share a digest.
DIGESTS: tuple[Callable[[bytes], bytes], ...] = (digest_128, digest_512)


def cut_places(data: np.ndarray) -> np.ndarray:
    """Ends of the windows at which a text may be cut, in order."""
    if len(data) <= LEAST:
        return np.empty(0, np.int64)
    found = []
    for lo in range(LEAST - WINDOW, len(data) - WINDOW + 1, 1 << 20):  # windows that begin in this part
        part = np.ascontiguousarray(data[lo : min(len(data), lo + (1 << 20) + WINDOW - 1)])
        windows = np.lib.stride_tricks.as_strided(part.view(np.uint8), (len(part) - WINDOW + 1, WINDOW), (1, 1))
        key = np.ascontiguousarray(windows).view("<u8").ravel() * _MIX
        found.append(np.flatnonzero(key >> np.uint64(64 - CUT_BITS) == 0) + lo + WINDOW)
    return np.concatenate(found)


def chunk_ends(data: np.ndarray) -> list[int]:
    """Ends of a text's chunks; all but the last hold LEAST to MOST bytes. An empty text has none."""
    n, ends, at = len(data), [], 0
    places = cut_places(data)
    while n - at > LEAST:
        k = int(np.searchsorted(places, at + LEAST))
        end = int(places[k]) if k < len(places) and places[k] <= at + MOST else at + MOST
        if end >= n:
            break
        ends.append(end)
        at = end
    return ends + [n] if n else ends


def texts_of(column: pa.Array) -> Iterator[np.ndarray]:
    """The bytes of each value of a binary column, without copies."""
    buffers = column.buffers()
    wide = pa.types.is_large_binary(column.type)
    starts = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.empty(0, np.uint8)
    return (data[a:b] for a, b in zip(starts, starts[1:]))


def chunked(data: np.ndarray) -> list[bytes]:
    raw, out, at = data.tobytes(), [], 0
    for end in chunk_ends(data):
        out.append(raw[at:end])
        at = end
    return out


def content(text: Column) -> Column:
    return F.coalesce(text.cast("binary"), F.lit(b""))


def recipes(docs: DataFrame, text_col: str = "text", digest: Callable[[bytes], bytes] = digest_128) -> DataFrame:
    """The rows of docs without the text, with `recipe` (the digests of its chunks, one after the other) and `n_chunks`."""
    keep = [c for c in docs.columns if c != text_col]
    out = B.schema_with(docs.select(*keep), "recipe binary, n_chunks long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [[digest(c) for c in chunked(x)] for x in texts_of(b.column(len(keep)))]
            made = [pa.array([b"".join(x) for x in own], pa.binary()), pa.array(map(len, own), pa.int64())]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), *made], names=out.names)

    return B.bounded_batches(docs).select(*keep, content(F.col(f"`{text_col}`"))).mapInArrow(run, out)


def recipe_key(recipe: Column) -> Column:
    return F.unhex(F.md5(recipe))


def chunk_table(docs: DataFrame, text_col: str = "text", digest: Callable[[bytes], bytes] = digest_128, wanted: B.BitFilter | None = None) -> DataFrame:
    """digest, chunk: the distinct chunks of the texts, or of those whose recipe's key passes a filter.

    The rows of one digest lie in one partition, each different chunk once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[bytes, bytes] = {}
        held = 0
        for b in batches:
            out: list[tuple[bytes, bytes]] = []
            for x in texts_of(b.column(0)):
                own = chunked(x)
                named = [digest(c) for c in own]
                if wanted is not None and not wanted.has(np.frombuffer(hashlib.md5(b"".join(named)).digest()[:8], ">u8").astype(np.uint64))[0]:
                    continue
                for name, chunk in zip(named, own):
                    if sent.get(name) == chunk:
                        continue
                    if held + len(chunk) > SENT_BYTES:
                        sent, held = {}, 0
                    held += len(chunk)
                    sent[name] = chunk
                    out.append((name, chunk))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.binary()) for k in (0, 1)], names=["digest", "chunk"])

    found = B.bounded_batches(docs).select(content(F.col(f"`{text_col}`")).alias("text")).mapInArrow(run, "digest binary, chunk binary")
    return found.repartition("digest").distinct()


def key_hash(key: Column) -> Column:
    """The first eight bytes of a key as a long."""
    high, low = (F.conv(F.hex(F.substring(key, k, 4)), 16, 10).cast("long") for k in (1, 5))
    return F.shiftleft(high, 32).bitwiseOR(low)


def verified(docs: DataFrame, text_col: str, groups: DataFrame, digest: Callable[[bytes], bytes]) -> bool:
    """Whether the digests of the chunks, and the keys of the recipes, of all repeated recipes name one content each."""
    twice = groups.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    if twice.limit(1).count():
        return False
    repeated = groups.filter("n > 1").select(key_hash(F.col("key")).alias("h"))
    if not repeated.limit(1).count():
        return True
    chunks = chunk_table(docs, text_col, digest, B.BitFilter.of(repeated))
    return not chunks.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, keep_id, group_size, kept, text_sha256, n_chunks: one row for every row of docs, dropped ones too.

    Texts are equal when all their bytes are; null counts as empty. Of equal texts the row with the largest id
    stays, null ids last; of rows that share that id exactly one. Other columns are ignored, an empty table gives an
    empty one. A text of any length is held once by the task that reads it.
    """
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    for digest in DIGESTS:
        hashed = texts.select("id", F.unhex(F.sha2(content(F.col("text")), 256)).alias("sha"), "text")
        own = recipes(hashed, "text", digest).withColumn("key", recipe_key(F.col("recipe"))).withColumn("row", F.monotonically_increasing_id())
        rows = B.materialize(own, "recipes")
        best = F.max(F.struct("id", "row")).alias("best")
        groups = B.materialize(rows.groupBy("key", "recipe").agg(best, F.count("*").alias("n")), "groups")
        if verified(texts, "text", groups, digest):
            break
    else:
        raise ValueError("two chunks share a digest of 512 bits")
    stays = groups.select("key", "n", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"))
    found = B.skew_join(rows.select("id", "row", "key", "sha", "n_chunks"), stays, "key", "n", rows.count())
    return found.select(F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "n_chunks")
