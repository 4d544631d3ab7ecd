"""Byte-pair encoding and decoding with a segment tree over the ranks of adjacent pairs.

Every word keeps a tree whose leaves are (rank, position) of its adjacent symbol pairs; the root is
the leftmost pair of the lowest rank. A merge rewrites the leaves beside it and their ancestors, so
each step takes time logarithmic in the word. Words of a batch advance together as rows of arrays.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from . import _base as B

NONE = np.int64(1) << 60
#: Words whose encoding a worker remembers, and bytes of text it encodes at a time.
MEMO_WORDS, CHUNK_BYTES = 400_000, 1_500_000
#: Words of more symbols than this go through the scalar tree.
WIDE = 64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class SegmentTree:
    """Minimum over int keys with point updates in logarithmic time."""

    def __init__(self, keys: list[int]):
        self.size = 1 << max(0, len(keys) - 1).bit_length()
        self.node = [int(NONE)] * self.size + keys + [int(NONE)] * (self.size - len(keys))
        for i in range(self.size - 1, 0, -1):
            self.node[i] = min(self.node[2 * i], self.node[2 * i + 1])

    def root(self) -> int:
        return self.node[1]

    def set(self, at: int, key: int) -> None:
        node, at = self.node, at + self.size
        node[at] = key
        while at > 1:
            at >>= 1
            node[at] = min(node[2 * at], node[2 * at + 1])


class BpeCodec:
    """Encodes and decodes as the tokenizers library does with a byte-level BPE file.

    Special tokens in a text are recognised as the library's default has it; none are added;
    truncation and padding are unused. A null text counts as empty.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE":
            raise ValueError(f"not a BPE vocabulary: {path}")
        self.library = Tokenizer.from_file(path)
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.special_re = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.n_ids = max([*vocab.values(), *self.special.values()]) + 1
        symbols = byte_symbols()
        self.byte_of = {c: b for b, c in enumerate(symbols)}
        self.first = np.array([vocab[c] for c in symbols], dtype=np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in symbols], dtype=np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right, made = (np.array(x, dtype=np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in pairs)))
        keys, ranks = np.unique(left * self.n_ids + right, return_index=True)
        self.pair_key, self.pair_rank, self.made = keys, ranks.astype(np.int64), made
        self.ranks = {int(k): int(r) for k, r in zip(keys, ranks)}
        token = {i: t for t, i in chain(vocab.items(), self.special.items())}
        self.tokens = np.array([token.get(i, "").encode() for i in range(self.n_ids)], dtype=object)
        self.joiner = b" " if spec.get("decoder") is None else None
        split = next((p for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"), None)
        #: White space separates words and leaves no token, so words can be encoded one by one.
        self.drops_space = bool(split and split["behavior"] == "Removed" and split["invert"] and (spec["normalizer"] or {}).get("type") == "Sequence")
        self.word_re = regex.compile(split["pattern"]["Regex"]) if self.drops_space else None
        self.memo: dict[str, bytes] = {}

    # -- from text to words ------------------------------------------------------------------

    def chunks(self, text: str | None) -> list[str]:
        """Parts of a text that can be encoded apart from each other."""
        if not text:
            return []
        if not self.drops_space or regex.search(r"[\x1c-\x1f]", text):
            return [text]
        return text.split()

    def pieces(self, chunk: str) -> list[bytes | int]:
        """Words of a chunk as bytes, special tokens as ids."""
        if self.drops_space and max(chunk) < "ɐ" and "<|" not in chunk:  # composed already, lower() is the library's
            low = chunk.lower()
            return [low.encode()] if low.isalpha() else [w.encode() for w in self.word_re.findall(low)]
        out: list[bytes | int] = []
        at = 0
        for m in self.special_re.finditer(chunk) if self.special_re else ():
            out += [*self.plain(chunk[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return out + self.plain(chunk[at:])

    def plain(self, part: str) -> list[bytes]:
        if not part:
            return []
        if self.library.normalizer:
            part = self.library.normalizer.normalize_str(part)
        return [bytes(self.byte_of[c] for c in w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(part) if w]

    # -- from words to ids -------------------------------------------------------------------

    def merge_one(self, word: bytes) -> list[int]:
        """Ids of one word; the plain form of the batched merge below."""
        ids = [*self.first[list(word[:-1])].tolist(), int(self.last[word[-1]])]
        n = len(ids)
        rank = lambda a, b: self.ranks.get(ids[a] * self.n_ids + ids[b])
        key = lambda a, b: int(NONE) if (r := rank(a, b)) is None else r * n + a
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = SegmentTree([key(i, i + 1) for i in range(n - 1)])
        while (root := tree.root()) < NONE:
            at, rank_ = root % n, root // n
            gone, prev = after[at], before[at]
            ids[at] = int(self.made[rank_])
            ids[gone] = -1
            after[at] = nxt = after[gone]
            if gone < n - 1:
                tree.set(gone, int(NONE))
            if nxt < n:
                before[nxt] = at
                tree.set(at, key(at, nxt))
            else:
                tree.set(at, int(NONE))
            if prev >= 0:
                tree.set(prev, key(prev, at))
        return [x for x in ids if x >= 0]

    def keyed(self, a: np.ndarray, b: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        """Tree keys of pairs at positions; NONE where no merge is known or a side is missing."""
        pair = a * self.n_ids + b
        slot = np.minimum(np.searchsorted(self.pair_key, pair), len(self.pair_key) - 1)
        return np.where((self.pair_key[slot] == pair) & (a >= 0) & (b >= 0), self.pair_rank[slot] * width + at, NONE)

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        length = np.fromiter(map(len, words), np.int64, len(words))
        width = 1
        while width < WIDE:
            width *= 2
            own = np.nonzero((length <= width) & (length > (width // 2 if width > 2 else 0)))[0]
            for part in np.array_split(own, max(1, len(own) * width // 400_000)):
                if len(part):
                    self._merge_group([words[i] for i in part], length[part], width, part, out)
        for i in np.nonzero(length > WIDE)[0]:
            out[i] = np.array(self.merge_one(words[i]), dtype="<u4").tobytes()
        return out

    def _merge_group(self, words: list[bytes], n: np.ndarray, width: int, to: np.ndarray, out: list[bytes]) -> None:
        """width: symbols a row, a power of two; the tree has a leaf for each, the last always NONE."""
        rows = len(words)
        there = np.arange(width) < n[:, None]
        raw = np.zeros((rows, width), dtype=np.uint8)
        raw[there] = np.frombuffer(b"".join(words), dtype=np.uint8)
        sym = np.full((rows, width + 1), -1, dtype=np.int64)
        sym[:, :width][there] = self.first[raw[there]]
        every = np.arange(rows)
        sym[every, n - 1] = self.last[raw[every, n - 1]]
        after = np.tile(np.arange(1, width + 2), (rows, 1))
        after[:, width] = width
        before = np.tile(np.arange(-1, width), (rows, 1))
        tree = np.full((rows, 2 * width), NONE, dtype=np.int64)
        tree[:, width:] = self.keyed(sym[:, :width], sym[:, 1:], np.arange(width), width)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2

        def put(r: np.ndarray, at: np.ndarray, key: np.ndarray) -> None:
            node = at + width
            tree[r, node] = key
            for _ in range(width.bit_length() - 1):
                node = node >> 1
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])

        live = every
        while len(live := live[tree[live, 1] < NONE]):
            root = tree[live, 1]
            at = root % width
            gone = after[live, at]
            nxt, prev = after[live, gone], before[live, at]
            sym[live, at] = self.made[root // width]
            sym[live, gone] = -1
            after[live, at] = nxt
            before[live, np.minimum(nxt, width)] = at
            has = gone < width
            put(live[has], gone[has], np.full(has.sum(), NONE))
            put(live, at, self.keyed(sym[live, at], sym[live, np.minimum(nxt, width)], at, width))
            has = prev >= 0
            r, p = live[has], prev[has]
            put(r, p, self.keyed(sym[r, p], sym[r, at[has]], p, width))
        left = sym[:, :width] >= 0
        flat = sym[:, :width][left].astype("<u4").tobytes()
        ends = (np.cumsum(left.sum(axis=1)) * 4).tolist()
        start = 0
        for i, end in zip(to.tolist(), ends):
            out[i] = flat[start:end]
            start = end

    # -- whole texts -------------------------------------------------------------------------

    def encode_batch(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, in order."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < CHUNK_BYTES):
                size += len(texts[end] or "")
                end += 1
            split = [self.chunks(t) for t in texts[at:end]]
            new = list(set(chain.from_iterable(split)).difference(self.memo))
            if len(self.memo) + len(new) > MEMO_WORDS:
                self.memo = {}
                new = list(set(chain.from_iterable(split)))
            self.memo.update(zip(new, self._encode_chunks(new)))
            get = self.memo.__getitem__
            yield from (b"".join(map(get, x)) for x in split)
            if not self.drops_space:
                self.memo = {}
            at = end

    def _encode_chunks(self, chunks: list[str]) -> Iterable[bytes]:
        parts = [self.pieces(c) for c in chunks]
        words = list({w for p in parts for w in p if isinstance(w, bytes)})
        ids = dict(zip(words, self.merge_many(words)))
        return (b"".join(ids[w] if isinstance(w, bytes) else w.to_bytes(4, "little") for w in p) for p in parts)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(next(self.encode_batch([text])), dtype="<u4").tolist()

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text; special tokens are kept."""
        if self.joiner is None:
            return self.library.decode(ids.tolist(), skip_special_tokens=False).encode()
        return self.joiner.join(self.tokens[ids].tolist())


_codecs: dict[str, BpeCodec] = {}


def codec(path: str) -> BpeCodec:
    """One codec a worker process and file."""
    if path not in _codecs:
        _codecs[path] = BpeCodec(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode the whole text of every row: id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded].

    A null or empty text has no tokens and decodes to the empty text. Rows are independent: repeated
    rows give repeated results, an empty table an empty one; other columns are ignored. One pass
    without a shuffle; a worker holds a batch of texts and a bounded memo of words.
    """

    def run(texts: list[str | None]) -> tuple[None, pd.DataFrame]:
        own, rows = codec(path), []
        for raw in own.encode_batch(texts):
            ids = np.frombuffer(raw, dtype="<u4")
            text = own.decode_bytes(ids)
            rows.append((len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(text).hexdigest(), *((ids.tolist(), text.decode(errors="replace")) if with_ids else ())))
        return None, pd.DataFrame(rows, columns=names)

    names = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])]
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * with_ids
    return B.beside(docs, [id_col], [text_col], run, schema)
