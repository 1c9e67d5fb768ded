"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The model is compiled to arcs: the normaliser (space to U+2581, a leading one added), one arc for each piece and,
for characters without a piece, one for each of their bytes. Composing the arcs with an input gives a lattice
whose tropical-semiring shortest path is the segmentation.

Unigram models: an arc weighs minus its score. Byte-pair models: what merging gives is no least sum of scores,
but it is decided by neighbours: (a, b) may stand side by side exactly if merging the text of a and b gives a
and b. Arcs then weigh nothing and the step from a to b weighs infinity where the pair can't stand; one path of
finite weight is left, to the end and to every state before it, so the last piece is known by the state alone.
Lattices of many words are searched at once, position by position, in numpy.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced
from .remembered import Remembered, steps, text_bytes

SPACE = "▁"
#: Lattices that are searched at once.
SWEPT = 20_000
INFINITE = float("inf")
#: Weight of a character that has no piece, in unigram models.
WITHOUT_PIECE = 1e6


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def fields(data: bytes):
    """(number, value) of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + n]
            at += n


def lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: int) -> np.ndarray:
    """The values of the wanted ones among ascending keys."""
    if not len(keys):
        return np.full(len(wanted), missing)
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[i] == wanted, values[i], missing)


class Transducer:
    def __init__(self, path: str):
        self.pieces, scores, kinds, bpe, prefix, squeeze, rules = [], [], [], False, True, True, b""
        with open(path, "rb") as f:
            message = f.read()
        for number, value in fields(message):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
                kinds.append(piece.get(3, 1))
            elif number == 2:
                bpe = dict(fields(value)).get(3, 1) == 2
            elif number == 3:
                spec = dict(fields(value))
                prefix, squeeze, rules = spec.get(3, 1), spec.get(4, 1), spec.get(2, b"")
        if rules or squeeze or 4 in kinds:
            raise ValueError("only identity normalisers that keep white space, without user-defined pieces, are compiled")
        self.bpe, self.prefix = bpe, bool(prefix)
        self.byte_ids = np.zeros(256, np.uint32)
        self.piece_bytes = []
        for i, (p, k) in enumerate(zip(self.pieces, kinds)):
            if k == 6:
                self.byte_ids[int(p[3:5], 16)] = i
            self.piece_bytes.append(bytes([int(p[3:5], 16)]) if k == 6 else b" \xe2\x81\x87 " if k == 2 else b"" if k == 3 else p.replace(SPACE, " ").encode())
        normal = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == 1}
        stands_alone = self.compile_merges(normal, scores) if bpe else np.ones(len(self.pieces), bool)
        #: Weight of each arc; the last one is that of a character without a piece.
        self.weight = np.append(np.zeros(len(scores)) if bpe else -np.array(scores), 0.0 if bpe else WITHOUT_PIECE)
        self.compile_arcs({p: i for p, i in normal.items() if stands_alone[i]})
        inner = {c for p in normal for c in p}
        whole = all(SPACE not in p.lstrip(SPACE) for p in normal)
        # No piece crosses these places, so parts between them are composed on their own.
        self.parted, self.line_end = whole, whole and "\n" not in inner
        self.remembered = Remembered(self.compose)

    def compile_arcs(self, pieces: dict[str, int]) -> None:
        """The states (beginnings of pieces), the steps between them by character, and the piece that ends in a state, if any."""
        states, steps_, ends = {"": 0}, {}, [-1]
        for p, i in pieces.items():
            for n in range(1, len(p) + 1):
                if p[:n] not in states:
                    steps_[states[p[: n - 1]] << 21 | ord(p[n - 1])] = states[p[:n]] = len(states)
                    ends.append(-1)
            ends[states[p]] = i
        self.step_key = np.array(sorted(steps_), np.int64)
        self.step_to, self.ends = np.array([steps_[k] for k in sorted(steps_)], np.int64), np.array(ends, np.int64)
        self.longest = max(map(len, pieces), default=0)

    def compile_merges(self, pieces: dict[str, int], scores: list[float]) -> np.ndarray:
        """For byte-pair models: which two pieces merge, when, and of which two pieces each piece is merged last.

        rank: the order in which merges are made, 0 for characters. A piece that merging its own text doesn't give is never the
        result of merging anything; returns the others. Pieces are worked out by length, since their parts are shorter.
        """
        n = len(self.pieces)
        # The last entry of each array stands for a character without a piece (-1), which never merges.
        self.rank, self.left, self.right = np.zeros(n + 1, np.int64), np.append(np.arange(n), -1), np.append(np.arange(n), -1)
        order = sorted((p for p in pieces if len(p) > 1), key=lambda p: (-scores[pieces[p]], pieces[p]))
        self.rank[[pieces[p] for p in order]] = np.arange(1, len(order) + 1)
        made = [(len(p), pieces[p], pieces[p[:k]], pieces[p[k:]]) for p in order for k in range(1, len(p)) if p[:k] in pieces and p[k:] in pieces]
        size, whole, a, b = np.array(made, np.int64).reshape(-1, 4).T
        key = (a + 1) << 32 | (b + 1)
        by = np.argsort(key)
        self.pair_key, self.pair_rank = key[by], self.rank[whole[by]]
        stands_alone = np.append(self.rank[:-1] == 0, True)
        for length in np.unique(size):
            i = np.flatnonzero((size == length) & stands_alone[a] & stands_alone[b])
            i = i[self.stand(a[i], b[i], self.rank[whole[i]])]
            self.left[whole[i]], self.right[whole[i]], stands_alone[whole[i]] = a[i], b[i], True
        return stands_alone[:-1]

    def stand(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | int = 1 << 40) -> np.ndarray:
        """Whether pieces a and b stay side by side when their texts are merged, until the merge of rank `before`.

        Merging is followed backwards from a|b: the merge made last is undone, and what then stood at the border must not
        have merged across it any earlier (leftmost first, where both are merges of one rank).
        """
        fine, i = np.ones(len(a), bool), np.arange(len(a))
        a, b, before = np.array(a), np.array(b), np.broadcast_to(np.asarray(before, np.int64), len(a)).copy()
        while len(i):
            across = lookup(self.pair_key, self.pair_rank, (a + 1) << 32 | (b + 1), 1 << 41) < before
            fine[i[across]] = False
            ra, rb = self.rank[a], self.rank[b]
            on = ~across & (ra + rb > 0)
            i, a, b, ra, rb = i[on], a[on], b[on], ra[on], rb[on]
            of_a = ra > rb
            before = np.where(of_a, ra, rb + 1)
            a, b = np.where(of_a, self.right[a], a), np.where(of_a, b, self.left[b])
        return fine

    def compose(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids along the shortest path of the lattice of each part, one after the other, and how many each has."""
        sizes = np.array([len(p) for p in parts], np.int64)
        out, count = [None] * len(parts), np.zeros(len(parts), np.int64)
        order = np.argsort(sizes, kind="stable")
        at = 0
        while at < len(order):  # parts of about a length, so that a sweep over positions serves many
            end = min(len(order), int(np.searchsorted(sizes[order], max(2 * sizes[order[at]], 16), "right")), at + SWEPT)
            rows = order[at:end]
            ids, n = self.shortest([parts[i] for i in rows])
            for i, x in zip(rows, np.split(ids, np.cumsum(n)[:-1])):
                out[i] = x
            count[rows] = n
            at = end
        return (np.concatenate(out) if out else np.zeros(0, np.uint32)), count

    def shortest(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tropical shortest paths of many lattices: arcs leave the states position by position, and the least sum that comes in stays."""
        n = np.array([len(p) for p in parts], np.int64)
        chars = np.frombuffer("".join(parts).replace(" ", SPACE).encode("utf-32-le"), "<u4").astype(np.int64)
        row = np.repeat(np.arange(len(n)), n)
        place, ends = steps(n), np.repeat(np.cumsum(n), n)
        live, state, found = np.arange(len(chars)), np.zeros(len(chars), np.int64), []
        for length in range(1, self.longest + 1):
            on = live + length <= ends[live]
            live, state = live[on], state[on]
            state = lookup(self.step_key, self.step_to, state << 21 | chars[live + length - 1], -1)
            live, state = live[state >= 0], state[state >= 0]
            piece = self.ends[state]
            found.append((live[piece >= 0], np.full(np.count_nonzero(piece >= 0), length), piece[piece >= 0]))
            if not len(live):
                break
        without = np.ones(len(chars), bool)
        if found:
            without[found[0][0]] = False
        found.append((np.flatnonzero(without), np.ones(np.count_nonzero(without), np.int64), np.full(np.count_nonzero(without), -1)))
        start, length, piece = (np.concatenate(c) for c in zip(*found))
        order = np.argsort(place[start], kind="stable")
        start, length, piece = start[order], length[order], piece[order]
        # A part of n characters has n + 1 states.
        source = start + row[start]
        target = source + length
        first = np.cumsum(n + 1) - (n + 1)
        cost, last, into = np.full(int((n + 1).sum()), INFINITE), np.full(int((n + 1).sum()), -1), np.full(int((n + 1).sum()), -1)
        cost[first] = 0.0
        edges = np.searchsorted(place[start], np.arange(int(n.max(initial=0)) + 1))
        for s, e in zip(edges[:-1], edges[1:]):
            arcs = np.arange(s, e)
            total = cost[source[s:e]] + self.weight[piece[s:e]]
            better = total < cost[target[s:e]]
            arcs, total = arcs[better], total[better]
            if self.bpe:  # the step weighs infinity where merging would not leave both pieces
                fine = self.stand(last[source[arcs]], piece[arcs])
                arcs, total = arcs[fine], total[fine]
            to = target[arcs]
            cost[to], last[to], into[to] = total, piece[arcs], arcs
        at, path = first + n, []
        while len(at):
            arcs = into[at]
            arcs = arcs[arcs >= 0]
            path.append(arcs)
            at = source[arcs]
        path = np.concatenate(path) if path else np.zeros(0, np.int64)
        path = path[np.argsort(start[path])]
        ids, each = piece[path].astype(np.uint32), np.ones(len(path), np.int64)
        if (bare := np.flatnonzero(piece[path] < 0)).size:
            raw = [chr(c).encode("utf-8", "replace") for c in chars[start[path[bare]]]]
            each[bare] = [len(x) for x in raw]
            own = np.repeat(piece[path] >= 0, each)
            out = np.empty(each.sum(), np.uint32)
            out[own], out[~own] = ids[piece[path] >= 0], self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
            ids = out
        return ids, np.bincount(row[start[path]], weights=each, minlength=len(n)).astype(np.int64)

    def encode_column(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit; null and empty texts have none."""
        data, at = text_bytes(texts)
        some = np.flatnonzero(np.diff(at))
        if self.prefix:
            data, at = np.insert(data, at[:-1][some], 32), at + np.concatenate([[0], np.cumsum(np.diff(at) > 0)])
        begin = np.zeros(len(data), bool)
        begin[at[:-1][some]] = True
        if self.parted and b"\xe2\x96\x81" not in data.tobytes():
            space = data == 32
            begin[1:] |= space[1:] & ~space[:-1]
            if self.line_end:
                line = data == 10
                begin |= line
                begin[1:] |= line[:-1]
        elif self.parted:
            # The mark that stands for a space counts as one.
            for i in some:
                begin[at[i] : at[i + 1]] |= self.begins(data[at[i] : at[i + 1]])
        first = np.flatnonzero(begin)
        size = np.diff(np.append(first, len(data)))
        ids, n = self.remembered.of(data, first, size)
        ends = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(first, at)]
        raw = ids.astype("<u4").tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def begins(self, data: np.ndarray) -> np.ndarray:
        text, out = data.tobytes().decode().replace(" ", SPACE), np.zeros(len(data), bool)
        at = 0
        held = data.tobytes().decode()
        end = "\n" if self.line_end else ""
        for part in re.finditer(f"{SPACE}+[^{SPACE}{end}]*" + "|\n" * bool(end) + f"|[^{SPACE}{end}]+", text):
            out[at] = True
            at += len(held[part.start() : part.end()].encode())
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_column(pa.array([text], pa.string()))[0]

    def decode(self, ids: bytes) -> str:
        out = b"".join(map(self.piece_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return out[1:] if self.prefix and out.startswith(" ") else out


@lru_cache(maxsize=1)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def encode_documents(docs: DataFrame, path: str | None = None, column: str = "text") -> DataFrame:
    """(doc_id, ids binary, n_tokens, decoded string), a row for each row of docs: null texts have null ids and zero tokens.

    ids: little-endian unsigned 32-bit, none for an empty text. decoded: the text that the ids give back, null for null;
    U+2581 comes back as a space. Texts of any length are taken whole; repeated rows and null ids stay as they are, and
    other columns are ignored, whatever their names. No rows give no rows.
    """
    path = path or default_model()

    def run(batches):
        t = transducer(path)
        for b in sliced(batches):
            texts = b.column(1)
            ids = [x if there else None for x, there in zip(t.encode_column(texts), texts.is_valid().to_pylist())]
            arrays = [b.column(0), pa.array(ids, pa.binary()), pa.array([len(x or b"") // 4 for x in ids], pa.int64())]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([None if x is None else t.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "n_tokens", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(column).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, ids binary, n_tokens long, decoded string")


def op1_sentencepiece(docs: DataFrame) -> DataFrame:
    """Counts and checksums of the ids, and a checksum of the text that they decode to."""
    return encode_documents(docs).select(
        "doc_id",
        "n_tokens",
        F.crc32(F.coalesce("ids", F.lit(b""))).alias("ids_crc32"),
        F.sha2(F.coalesce("decoded", F.lit("")).cast("binary"), 256).alias("decoded_sha256"),
    )
