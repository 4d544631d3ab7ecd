"""Matching token streams of documents against small sets of texts, many documents at a time."""

from __future__ import annotations

import re
from itertools import chain

import numpy as np

MEMO_WORDS = 300_000
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
NOT_WORD = re.compile(r"[\W_]+")


def normal(chunk: str) -> str:
    """Token of a chunk between white space: letters and digits in lower case."""
    low = chunk.lower()
    return low if low.isalnum() else NOT_WORD.sub("", low)


def tokens(text: str | None) -> list[str]:
    return [t for t in map(normal, (text or "").split()) if t]


class Vocabulary:
    """Numbers the tokens of the texts searched for from 1; 0 stands for every other token."""

    def __init__(self, texts: list[list[str]]):
        self.ids = {t: i for i, t in enumerate(dict.fromkeys(chain.from_iterable(texts)), 1)}
        rng = np.random.default_rng(7)
        self.codes = rng.integers(1, 1 << 63, len(self.ids) + 1, dtype=np.uint64)
        self.memo: dict[str, int] = {}

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def number(self, texts: list[str | None]) -> list[np.ndarray]:
        """Token numbers of each text; chunks without letters or digits are left out."""
        split = [(t or "").split() for t in texts]
        new = set(chain.from_iterable(split)).difference(self.memo)
        if len(self.memo) + len(new) > MEMO_WORDS:
            self.memo = {}
            new = set(chain.from_iterable(split))
        for c in new:
            self.memo[c] = self.ids.get(n, 0) if (n := normal(c)) else -1
        get = self.memo.__getitem__
        out = []
        for x in split:
            ids = np.fromiter(map(get, x), np.int64, len(x))
            out.append(ids[ids >= 0])
        return out


def joined(docs: list[np.ndarray], gap: int) -> tuple[np.ndarray, np.ndarray]:
    """All token numbers in one array with `gap` foreign tokens after each document; the starts."""
    starts = np.concatenate(([0], np.cumsum([len(d) + gap for d in docs])))
    flat = np.zeros(int(starts[-1]), np.int64)
    for d, at in zip(docs, starts):
        flat[at : at + len(d)] = d
    return flat, starts


def batches(texts: list[str | None], size: int = 1_500_000):
    """Index ranges of texts of about `size` characters together."""
    at = 0
    while at < len(texts):
        end, n = at, 0
        while end < len(texts) and (end == at or n < size):
            n += len(texts[end] or "")
            end += 1
        yield at, end
        at = end
