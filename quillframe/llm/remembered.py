"""Ids of the parts of texts, remembered by a Python worker in flat arrays, and looked up for many parts at once.

Texts repeat their words; whatever makes ids (a transducer, a tokenizer) is asked once for each distinct part. A part is
known by its length, its first eight bytes and a 64-bit tabulation hash of all its bytes. An entry takes some 40 bytes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: Longer parts are made anew each time; entries after which those not used again are forgotten; parts looked up at once.
LONGEST, MOST, BLOCK = 64, 800_000, 65_536
TABLE = np.random.default_rng(20240611).integers(0, 1 << 64, LONGEST << 8, dtype=np.uint64)
#: The bytes of a word of eight that a part of 0 to 8 bytes has.
OWN = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
Make = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of an Arrow column, one after the other, and where each begins (and the last ends); nulls are empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[at[0] : at[-1]], at - at[0]


def steps(counts: np.ndarray) -> np.ndarray:
    """0, 1, … for each count, one after the other."""
    total = np.cumsum(counts)
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - counts, counts)


class Remembered:
    def __init__(self, make: Make, most: int | None = None):
        """make: ids of distinct parts, one after the other, and how many each has."""
        self.make, self.most = make, most or MOST
        self.forget()

    def forget(self) -> None:
        self.key, self.check, self.at = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.n, self.ids, self.used, self.again = np.zeros(0, np.int64), np.zeros(1 << 16, np.uint32), 0, np.zeros(0, bool)

    def shrink(self) -> None:
        """Keep what was used again since it was made or last kept; if that is most of it, start afresh."""
        stay = np.flatnonzero(self.again)
        key, check, n, at, ids = self.key[stay], self.check[stay], self.n[stay], self.at[stay], self.ids
        self.forget()
        if 2 * len(stay) <= self.most:
            self.add(key, check, ids[np.repeat(at, n) + steps(n)], n)

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return np.full(len(key), -1)
        i = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[i] == key) & (self.check[i] == check), i, -1)

    def add(self, key: np.ndarray, check: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """key: ascending, without those there are."""
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(ids), len(self.ids)), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        at = self.used + np.cumsum(n) - n
        self.used += len(ids)
        place = np.searchsorted(self.key, key)
        self.key, self.check = np.insert(self.key, place, key), np.insert(self.check, place, check)
        self.at, self.n, self.again = np.insert(self.at, place, at), np.insert(self.n, place, n), np.insert(self.again, place, False)

    def of(self, data: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts data[first : first + size], one after the other, and how many each has."""
        out = [self.block(data, first[a : a + BLOCK], size[a : a + BLOCK]) for a in range(0, len(first), BLOCK)]
        if not out:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return np.concatenate([x for x, _ in out]), np.concatenate([n for _, n in out])

    def block(self, data: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text = lambda i: data[first[i] : first[i] + size[i]].tobytes().decode("utf-8", "replace")
        short = np.flatnonzero(size <= LONGEST)
        f, s = first[short], size[short]
        step = steps(s)
        key = np.add.reduceat(TABLE[step << 8 | data[np.repeat(f, s) + step]], np.cumsum(s) - s) if len(s) else np.zeros(0, np.uint64)
        low, one, same = np.unique(key, return_index=True, return_inverse=True)
        # The first eight bytes, as far as the part goes.
        near = np.concatenate([data[f[one] + np.minimum(i, s[one] - 1)] for i in range(8)]).reshape(8, -1).astype(np.uint64)
        head = sum(near[i] << np.uint64(8 * i) for i in range(8)) & OWN[np.minimum(s[one], 8)] if len(one) else np.zeros(0, np.uint64)
        check = head ^ s[one].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        if len(self.key) > self.most:
            self.shrink()
        at = self.find(low, check)
        self.again[at[at >= 0]] = True
        if (new := np.flatnonzero(at < 0)).size:
            self.add(low[new], check[new], *self.make([text(i) for i in short[one[new]]]))
            at = self.find(low, check)
            if (at < 0).any():
                raise ValueError("two parts have one hash")
        count, start = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        count[short], start[short] = self.n[at][same], self.at[at][same]
        long = np.flatnonzero(size > LONGEST)
        extra, n = self.make([text(i) for i in long]) if long.size else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        count[long] = n
        out = np.empty(count.sum(), np.uint32)
        of_long = np.repeat(size > LONGEST, count)
        out[of_long] = extra
        c = count[short]
        out[~of_long] = self.ids[np.repeat(start[short], c) + steps(c)]
        return out, count
