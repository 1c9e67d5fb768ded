"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A fingerprint is cut into segments of 23, 23 and 18 bits. The binary Golay code (23, 12, 7) is perfect: every
23-bit word lies within 3 flips of exactly one of its 4096 codewords. A segment's fuzzy keys are the codeword
indices that the segment and its one-flip neighbours decode to; two segments at most 2 flips apart have a
common neighbour and so share a key. At most 2 flips over three segments leave one segment unchanged
(pigeonhole) and any other within 2 flips, so (a whole segment, a fuzzy key of the next one) is a join key that
no link escapes. Joined candidates are verified on the whole fingerprint.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, sliced

SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY_POLYNOMIAL = 0b110001110101


@lru_cache(maxsize=1)
def golay_table() -> np.ndarray:
    """Index of the nearest codeword for each of the 2^23 words (16 MB)."""
    message = np.arange(4096, dtype=np.int64) << 11
    rest = message.copy()
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GOLAY_POLYNOMIAL << (bit - 11)), rest)
    codewords = message | rest
    errors = np.array([sum(1 << i for i in c) for n in range(4) for c in combinations(range(23), n)])
    out = np.empty(1 << 23, np.int16)
    for e in errors:
        out[codewords ^ e] = np.arange(4096)
    return out


def fuzzy_keys(segment: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, codeword index) pairs of 23-bit words of which the lower `width` bits may flip."""
    flips = np.array([0] + [1 << i for i in range(width)], dtype=np.int64)
    index = np.sort(golay_table()[segment[:, None] ^ flips], axis=1)
    first = np.ones(index.shape, bool)
    first[:, 1:] = index[:, 1:] != index[:, :-1]
    row, col = np.nonzero(first)
    return row, index[row, col].astype(np.int64)


def simhash(text: str | None, words: int = 3) -> int:
    """64-bit SimHash of a text's word shingles, repeats included; zero for a text without words."""
    split = (text or "").encode("utf-8", "replace").lower().split()
    if not split:
        return 0
    whole = b" ".join(split)
    ends = list(accumulate(len(w) + 1 for w in split))
    starts = [0, *ends]
    digest, votes, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), max(1, len(split) - words + 1)
    last = ends[words - 1 :] or [len(whole) + 1]
    for at in range(0, n, 65536):
        h = np.fromiter((digest(whole[s : e - 1], 42) for s, e in zip(starts[at : at + 65536], last[at : at + 65536])), "<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp long) for each row; a null text counts as empty and has fingerprint zero."""

    def run(batches):
        for b in sliced(batches):
            fp = np.array([simhash(t, words) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def keyed(distinct: DataFrame) -> DataFrame:
    """(key, fp): about sixteen join keys for each distinct fingerprint."""

    def run(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            parts = [(fp.view(np.uint64) >> np.uint64(at)).astype(np.int64) & ((1 << w) - 1) for at, w in SEGMENTS]
            for i in range(3):
                j = (i + 1) % 3
                row, index = fuzzy_keys(parts[j], SEGMENTS[j][1])
                key = (i << 36) | (parts[i][row] << 12) | index
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], ["key", "fp"])

    return distinct.select("fp").mapInArrow(run, "key long, fp long")


def links(distinct: DataFrame, bits: int = 2) -> DataFrame:
    """(a, b): all pairs of distinct fingerprints at most `bits` (2 or fewer) bits apart."""
    if not 0 <= bits <= 2:
        raise ValueError("three segments find links of at most 2 bits")
    keys = cut(keyed(distinct))
    a, b = keys.select("key", F.col("fp").alias("a")), keys.select("key", F.col("fp").alias("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
    return a.join(b, "key").where(near).select("a", "b").distinct()


def simhash_components(docs: DataFrame, words: int = 3, bits: int = 2) -> DataFrame:
    """(doc_id, fp long, component_id) for each row of docs.

    Equal fingerprints are one node whatever the number of copies, so a group of copies costs one row after
    partial aggregation. component_id: smallest doc_id of the component. Null texts count as empty; null ids
    never become a component id unless a component has no other. Repeated rows and repeated ids stay, each row with
    the fingerprint of its own text; extra columns, whatever their names, are ignored; no rows give no rows.
    """
    fps = cut(fingerprints(docs, words))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes, bits))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    # Only linked fingerprints can differ from their own smallest id; the join below sees one row per fingerprint.
    of_fp = named.join(ids, "root").select("fp", "component_id")
    return fps.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def op9_simhash_near_dedup(docs: DataFrame) -> DataFrame:
    """Fingerprints in hexadecimal and components; edge cases as in simhash_components."""
    return simhash_components(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
