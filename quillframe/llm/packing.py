"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Supersteps over runs: pieces are numbered within their length, by distributed rows; since lengths are whole numbers
up to the capacity, equal pieces and equal gaps are interchangeable, and a sweep over pieces and gaps is one over at
most `capacity` runs of each, however many documents there are. A superstep takes the longest pieces not yet placed,
finds the successor (the smallest gap that holds them), resolves who gets which gap by rank, updates the gaps, and
repeats; pieces without a successor open new sequences. The supersteps run on the driver, over counts by length alone;
they yield ranges of ranks with their place, which the distributed rows look up.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, sliced, small
from .remembered import Remembered, text_bytes

CAPACITY, SEPARATOR = 2048, 0
#: Chunks that a Python worker remembers with their ids (some 10 MB).
REMEMBERED = 250_000
#: Chunks of these characters only: composed letters, so NFC changes nothing and letters, digits and signs are plain.
PLAIN = re.compile(r"[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e]*\Z")
WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00c0-\u017e]+|[0-9]|[^\sa-z0-9\u00c0-\u017e]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(other)) for b in range(256)]


class Chunks:
    """Ids of chunks between spaces and line ends. No token spans white space, so a text's ids are its chunks'."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        # A byte above 126 as the letter that byte-level vocabularies write for it.
        self.letters = {i: c for i, c in enumerate(byte_letters()) if i > 126}
        self.remembered = Remembered(self.encode, REMEMBERED)

    def word(self, word: str) -> list[int]:
        """A lower-case word of the tokenizer's own splitting."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.tok.model.tokenize(word)]

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out, n = [], []
        for chunk in chunks:
            before = len(out)
            if PLAIN.match(chunk) and "<|" not in chunk:
                for w in WORD.findall(chunk.lower()):
                    out += self.word(w)
            else:
                out += self.tok.encode(chunk, add_special_tokens=False).ids
            n.append(len(out) - before)
        return np.array(out, np.uint32), np.array(n, np.int64)


@lru_cache(maxsize=1)
def chunks(path: str) -> Chunks:
    return Chunks(path)


def encode_column(texts: pa.Array, path: str) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit, none for null; each distinct chunk is encoded once for a worker."""
    data, at = text_bytes(texts)
    white = (data == 32) | (data == 10)
    edge = white.copy()
    edge[1:] |= white[:-1]
    edge[at[:-1][np.diff(at) > 0]] = True
    first = np.flatnonzero(edge)
    size = np.diff(np.append(first, len(data)))
    own = ~white[first]
    first, size = first[own], size[own]
    ids, n = chunks(path).remembered.of(data, first, size)
    ends = (4 * np.concatenate([[0], np.cumsum(n)])[np.searchsorted(first, at)]).tolist()
    raw = ids.astype("<u4").tobytes()
    return [raw[a:b] for a, b in zip(ends[:-1], ends[1:])]


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids binary]): documents cut only where longer than the capacity.

    A document is its text's ids and the separator; null text counts as empty, so every row gives a piece. Words and texts
    of any length are taken whole; rows with null or repeated ids are documents of their own. Other columns are ignored.
    """
    path = path or default_tokenizer()
    end = np.array([SEPARATOR], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches):
        for b in sliced(batches):
            rows, cols = [], ([], [], [], [], [])
            for i, ids in enumerate(encode_column(b.column(1), path)):
                ids += end
                for p, s in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[s : s + 4 * capacity]
                    rows.append(i)
                    for c, v in zip(cols, (p, s // 4, len(part) // 4, zlib.crc32(part), part)):
                        c.append(v)
            arrays = [b.column(0).take(pa.array(rows, pa.int64()))]
            arrays += [pa.array(c, k) for c, k in zip(cols[:4], (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(cols[4], pa.binary())] * with_ids, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def sweep(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit places for `counts` pieces of each length: (length, first rank, pieces, first sequence, pieces a sequence, offset)."""
    places, gaps, there, opened = [], defaultdict(list), np.zeros(capacity + 1, bool), 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            g = length + int(there[length:].argmax())
            if there[g]:
                first, bins = gaps[g].pop()
                there[g] = bool(gaps[g])
            else:
                g, first = capacity, opened
                bins = -(-left // (capacity // length))
                opened += bins
            fit = g // length
            full = min(bins, left // fit)
            rest = left - full * fit if full < bins else 0
            places.append((length, rank, full * fit + rest, first, fit, capacity - g))
            used = full + (rest > 0)
            for gap, at, n in ((g - fit * length, first, full), (g - rest * length, first + full, int(rest > 0)), (g, first + used, bins - used)):
                if gap and n:
                    gaps[gap].append((at, n))
                    there[gap] = True
            rank, left = rank + full * fit + rest, left - full * fit - rest
    return places


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut_pieces with sequence_id long and offset long; every row gets one place, repeated rows and null ids too.

    Pieces of a length are numbered in salted groups of bounded size, so a length that a third of all pieces share,
    or a row that comes again a million times, is spread over many tasks. The driver sees counts by length only.
    cut_pieces must be stored (a table or checkpoint): it is read more than once. No pieces give no rows.
    """
    spark = cut_pieces.sparkSession
    counts = {r.length: r["n"] for r in cut_pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return cut_pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    per_group = max(256, sum(counts.values()) // 1_000_000)
    salts = spark.createDataFrame([(k, -(-n // per_group)) for k, n in counts.items()], "length long, groups long")
    numbered = cut_pieces.withColumn("row", F.monotonically_increasing_id())
    salted = numbered.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("row"), F.col("groups")).cast("long")).drop("groups")
    ranked = cut(salted.withColumn("local", F.row_number().over(Window.partitionBy("length", "salt").orderBy("row")).cast("long") - 1).drop("row"))
    sizes = cut(ranked.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    places = spark.createDataFrame(sweep(counts, capacity), "length long, rank0 long, n long, first long, each long, off long")
    rank = F.col("base") + F.col("local") - F.col("rank0")
    return (
        ranked.join(small(bases, sizes.count()), ["length", "salt"])
        .join(F.broadcast(places), "length")
        .where((rank >= 0) & (rank < F.col("n")))
        .withColumn("sequence_id", (F.col("first") + F.floor(rank / F.col("each"))).cast("long"))
        .withColumn("offset", F.col("off") + F.pmod(rank, F.col("each")) * F.col("length"))
        .select(*cut_pieces.columns, "sequence_id", "offset")
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    return pack(cut(pieces(docs, capacity, path, with_ids)), capacity)


def op3_best_fit_packing(docs: DataFrame) -> DataFrame:
    """Pieces with their places; edge cases as in pieces and pack."""
    return pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
