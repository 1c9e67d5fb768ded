"""Removal of repeated byte strings by suffix arrays.

1. Candidates, without loss: each length-400 string is named by the least hash of its 32-byte substrings, so
   equal strings have equal names wherever they are. Neighbouring positions share their name, which gives blocks
   (about 185 positions, 585 bytes). Names that only one block in the whole corpus has cannot repeat.
2. Blocks of repeated names are dealt to shards by name, equal blocks once. A shard concatenates its blocks and
   builds a suffix array by Larsson-Sadakane refinement, takes Kasai's common prefixes (both in numpy, over
   many lanes) and marks positions whose neighbour in the array shares 400 bytes.
3. A name with more blocks than one shard holds is dealt to several shards. Each of them then also gives its
   sorted run of strings (as 128-bit digests), and runs are merged across shards by binary search.
4. Marks are gathered for each distinct text, and every row of docs takes those of its text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, remove, sliced, workspace

LENGTH, GRAM = 400, 32
#: Bytes that one suffix array is built over; a name whose blocks have more is spread over several shards.
SHARD_BYTES = 1_000_000
#: Most positions of a block: longer ones (of periodic text) are cut into several blocks of the same name.
BLOCK_POSITIONS = 65_536
#: Bits of the filters that tell rows with work to do from others; a full filter only lets more rows through.
FILTER_BITS = 1 << 22
U = np.uint64


def _tables():
    rng = np.random.default_rng(20240607)
    odd = lambda: int(rng.integers(1 << 62)) * 2 + 1
    return [(rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1), odd() % (1 << 64)) for _ in range(2)]


TABLES = _tables()
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        base = TABLES[which][1]
        have = _powers[which] = tuple(
            np.cumprod(np.concatenate([[U(1)], np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (U(base), U(pow(base, -1, 1 << 64)))
        )
    return have[0][:n], have[1][:n]


def window_hashes(data: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each substring of `width` bytes, in time independent of the width."""
    n = len(data) - width + 1
    up, down = powers(which, len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(TABLES[which][0][data] * up, out=total[1:])
    h = (total[width:] - total[:n]) * down[:n]
    h ^= h >> U(31)
    h *= U(0x9E3779B97F4A7C15)
    return h ^ (h >> U(29))


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w values, by block prefixes and suffixes."""
    n, pad = len(h), -len(h) % w
    x = np.concatenate([h, np.full(pad, np.iinfo(h.dtype).max, h.dtype)]).reshape(-1, w)
    before = np.minimum.accumulate(x, 1).ravel()[:n]
    after = np.minimum.accumulate(x[:, ::-1], 1)[:, ::-1].ravel()[:n]
    return np.minimum(after[: n - w + 1], before[w - 1 :])


def blocks(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> list[tuple[int, int, int, int]]:
    """(name, first position, last position, anchors) of the blocks of a text; none if it is shorter than length."""
    if len(data) < length:
        return []
    w = length - gram + 1
    h = window_hashes(data, gram)
    m = sliding_min(h, w)
    first = np.concatenate([[0], np.flatnonzero(m[1:] != m[:-1]) + 1])
    last = np.concatenate([first[1:] - 1, [len(m) - 1]])
    names = m[first]
    out = []
    for v, s, e in zip(names, first.tolist(), last.tolist()):
        anchors = int(np.count_nonzero(h[s : e + w] == v))
        out += [(int(v), at, min(e, at + BLOCK_POSITIONS - 1), anchors) for at in range(s, e + 1, BLOCK_POSITIONS)]
    return out


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array by Larsson-Sadakane refinement, and the ranks.

    Suffixes are sorted by seven bytes, then groups that are still tied are refined by the rank of the suffix h
    places on, h doubling; sorted groups are left alone.
    """
    n = len(data)
    padded = np.concatenate([data.astype(np.uint64) + U(1), np.zeros(8, np.uint64)])
    key = np.zeros(n, np.uint64)
    for i in range(7):
        key = key * U(512) + padded[i : i + n]
    sa = np.argsort(key)
    sorted_key = key[sa]
    new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    # A group's rank is the place of its last member, so that ranks of sorted groups never change.
    ends = np.concatenate([np.flatnonzero(new)[1:] - 1, [n - 1]])
    rank = np.empty(n, np.int64)
    rank[sa] = ends[np.cumsum(new) - 1]
    h = 7
    single = new & np.concatenate([new[1:], [True]])
    active = np.flatnonzero(~single)
    while len(active):
        at = sa[active]
        ahead = at + h
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        group = rank[at]
        order = np.argsort(group * (n + 1) + second + 1)
        at, group, second = at[order], group[order], second[order]
        sa[active] = at
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])])
        starts = np.flatnonzero(new)
        ends = active[np.concatenate([starts[1:] - 1, [len(active) - 1]])]
        rank[at] = ends[np.cumsum(new) - 1]
        single = new & np.concatenate([new[1:], [True]])
        active = active[~single]
        h *= 2
    return sa, rank


def common_prefixes(data: np.ndarray, sa: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Kasai: the common prefix of each suffix with its predecessor in the array, at most `depth`, by text position.

    Kasai's bound (the next position shares at least one less) is followed in many lanes of the text at once.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, np.int32)
    lanes = max(1, min(n, 1 + n // 128))
    size = -(-n // lanes)
    wide = np.concatenate([data, np.zeros(depth + 16, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(wide, 8)
    at0 = np.arange(0, n, size)
    have = np.zeros(len(at0), np.int64)
    for k in range(size):
        at = at0 + k
        live = np.flatnonzero(at < n)
        p = at[live]
        q = before[p]
        have[live[q < 0]] = 0
        todo = live[q >= 0]
        while len(todo):
            a, g = at0[todo] + k, have[todo]
            b = before[a]
            end = np.minimum(depth, n - np.maximum(a, b))
            x = np.ascontiguousarray(words[np.minimum(a + g, n + depth)]).view("<u8").ravel() ^ np.ascontiguousarray(words[np.minimum(b + g, n + depth)]).view("<u8").ravel()
            low = x & (~x + U(1))
            same = np.where(x == 0, 8, np.frexp(low.astype(np.float64))[1].astype(np.int64) - 1 >> 3)
            g2 = np.minimum(g + same, end)
            have[todo] = g2
            todo = todo[(same == 8) & (g2 < end)]
        out[p] = have[live]
        have[live] = np.maximum(have[live] - 1, 0)
    return out


def shard_marks(texts: list[bytes], starts: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For blocks (their bytes, and how many positions of each count) whether each position's string is elsewhere too."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sa, _ = suffix_array(data)
    shared = common_prefixes(data, sa, length)
    sizes = np.array([len(t) for t in texts])
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    # A string that would run over the end of its block is none.
    whole = np.zeros(len(data), bool)
    for f, s in zip(first, starts):
        whole[f : f + s] = True
    # Ties in the array are runs of neighbours that share `length`; strings over a block's end split no run,
    # since a run of equal strings is judged by its counted members only.
    run = np.cumsum(np.concatenate([[True], shared[sa[1:]] < length]))
    counted = whole[sa]
    number = np.bincount(run[counted], minlength=run[-1] + 1)
    repeated = np.zeros(len(data), bool)
    repeated[sa] = counted & (number[run] > 1)
    return [repeated[f : f + s] for f, s in zip(first, starts)]


def spans_of(flags: np.ndarray, offset: int) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a) + offset, int(b) - 1 + offset) for a, b in zip(edge[::2], edge[1::2])]


def text_key(raw: bytes) -> bytes:
    return hashlib.sha256(raw).digest()[:16]


def named_blocks(docs: DataFrame, length: int) -> DataFrame:
    """(digest, doc_id, name, first, last, anchors, content) of each row's blocks; content: a hash of the block's bytes."""
    names = ["digest", "doc_id", "name", "first", "last", "anchors", "content"]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for part in sliced(batches, 64):
            rows, out = [], ([], [], [], [], [], [])
            for i, text in enumerate(part.column(1).to_pylist()):
                raw = (text or "").encode("utf-8", "replace")
                if len(raw) >= length:
                    d = text_key(raw)
                    for v, s, e, n in blocks(np.frombuffer(raw, np.uint8), length):
                        content = int.from_bytes(hashlib.blake2b(raw[s : e + length], digest_size=8).digest(), "little", signed=True)
                        rows.append(i)
                        for c, x in zip(out, (d, v - (1 << 63), s, e, n, content)):
                            c.append(x)
            arrays = [pa.array(c, pa.binary() if i == 0 else pa.int64()) for i, c in enumerate(out)]
            ids = part.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([arrays[0], ids, *arrays[1:]], names)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"digest binary, doc_id {kind}, name long, first long, last long, anchors long, content long"
    )


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def bits_of(keys: DataFrame, column) -> np.ndarray:
    """A bit for each hash of the keys: bounded, whatever their number. No key is missed; some others may pass."""
    hashed = keys.select(F.pmod(F.xxhash64(column), F.lit(FILTER_BITS)).cast("int").alias("h"))
    rows = hashed.selectExpr("h div 8 as byte", "shiftleft(1, h % 8) as bit")
    got = rows.groupBy("byte").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    out[got.byte.to_numpy(np.int64)] = got.bits.to_numpy(np.int64).astype(np.uint8)
    return out


def in_bits(bits: np.ndarray, key: bytes) -> bool:
    h = _signed(xxhash.xxh64_intdigest(key, 42)) % FILTER_BITS
    return bool(bits[h >> 3] >> (h & 7) & 1)


def row_key(digest: bytes, doc_id) -> bytes:
    return digest + str(doc_id).encode()


def texts_of(ask: DataFrame, docs: DataFrame) -> DataFrame:
    """(digest, doc_id, raw) of the rows that hold the asked texts; of all others only a bit is looked at."""
    key = F.concat("digest", F.coalesce(F.col("doc_id").cast("string"), F.lit("None")).cast("binary"))
    held = docs.sparkSession.sparkContext.broadcast(bits_of(ask, key))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in sliced(batches):
            ids, raws, digests = [], [], []
            for i, (own, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                raw = (text or "").encode("utf-8", "replace")
                if in_bits(held.value, row_key(d := text_key(raw), own)):
                    ids.append(i)
                    raws.append(raw)
                    digests.append(d)
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), b.column(0).take(pa.array(ids, pa.int64())), pa.array(raws, pa.binary())], ["__digest", "__id", "raw"])

    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"__digest binary, __id {kind}, raw binary")
    on = (F.col("digest") == F.col("__digest")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    return ask.join(found, on).drop("__digest", "__id")


RUN = np.dtype([("h0", "<i8"), ("h1", "<i8"), ("content", "<i8"), ("at", "<i8"), ("single", "<i8")])


def sorted_run(blocks_: list[tuple[int, bytes]], length: int) -> bytes:
    """The distinct strings of a shard's share of one name, sorted by their 128-bit digest, with the place of one each."""
    parts = []
    for content, text in blocks_:
        data, n = np.frombuffer(text, np.uint8), len(text) - length + 1
        r = np.empty(n, RUN)
        r["h0"], r["h1"] = (window_hashes(data, length, i)[:n].view(np.int64) for i in (0, 1))
        r["content"], r["at"] = content, np.arange(n)
        parts.append(r)
    r = np.concatenate(parts)
    r = r[np.lexsort((r["h1"], r["h0"]))]
    new = np.concatenate([[True], (r["h0"][1:] != r["h0"][:-1]) | (r["h1"][1:] != r["h1"][:-1])])
    count = np.diff(np.concatenate([np.flatnonzero(new), [len(r)]]))
    r = r[new]
    r["single"] = count == 1
    return r.tobytes()


def shard_task(length: int):
    schema = pa.schema([("name", pa.int64()), ("content", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), ("run", pa.binary())])

    def flush(rows):
        marks = shard_marks([r[3] for r in rows], [len(r[3]) - length + 1 for r in rows], length)
        out, spread = [], {}
        for (name, content, shards, text, salt), flags in zip(rows, marks):
            out.append({"name": name, "content": content, "spans": [{"first": a, "last": b} for a, b in spans_of(flags, 0)], "run": None})
            if shards > 1:
                spread.setdefault((name, salt), []).append((content, text))
        out += [{"name": name, "content": None, "spans": None, "run": sorted_run(b, length)} for (name, _), b in spread.items()]
        return pa.RecordBatch.from_pylist(out, schema)

    def run(batches):
        seen, rows, size, key = set(), [], 0, None
        for b in batches:
            for name, content, shards, salt, text in zip(*(b.column(i).to_pylist() for i in range(5))):
                if (name, salt) != key:
                    if size >= SHARD_BYTES:
                        yield flush(rows)
                        rows, size = [], 0
                    key, seen = (name, salt), set()
                if content not in seen:  # repeated rows of a text give its blocks again
                    seen.add(content)
                    rows.append((name, content, shards, text, salt))
                    size += len(text)
        if rows:
            yield flush(rows)

    return run


def across_shards(marked: DataFrame) -> DataFrame:
    """(name, content, more): positions whose string is alone in its shard but is in another shard too.

    The shards' sorted runs are dealt by ranges of the digest; within a range, binary search finds for each string
    the first and last of its equals.
    """

    def rows(batches):
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                r = np.frombuffer(raw, RUN)
                cols = [pa.array(np.ascontiguousarray(r[c])) for c in RUN.names]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), name)), *cols], ["name", *RUN.names])

    def merge(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            h0 = t.column("h0").to_numpy()
            end = int(np.searchsorted(h0, h0[-1], "left")) if len(h0) else 0
            held = t.slice(end)  # its equals may go on in the next batch
            yield from found(t.slice(0, end))
        if held is not None:
            yield from found(held)

    def found(t):
        h0, h1 = t.column("h0").to_numpy(), t.column("h1").to_numpy()
        if len(h0):
            several = np.searchsorted(h0, h0, "right") - np.searchsorted(h0, h0, "left") > 1
            same = (h0[1:] == h0[:-1]) & (h1[1:] == h1[:-1])
            equal = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            yield from t.filter(pa.array(several & equal & (t.column("single").to_numpy() == 1))).select(["name", "content", "at"]).to_batches()

    strings = marked.where("run is not null").select("name", "run").mapInArrow(rows, "name long, h0 long, h1 long, content long, at long, single long")
    ordered = strings.repartitionByRange("h0").sortWithinPartitions("h0", "h1")
    alone = ordered.mapInArrow(merge, "name long, content long, at long")
    return alone.groupBy("name", "content").agg(F.transform(F.collect_set("at"), lambda x: F.struct(x.alias("first"), x.alias("last"))).alias("more"))


def repeated_positions(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(digest, spans array<struct<first,last>>) for texts with repeated strings: positions where one begins."""
    spark = docs.sparkSession
    path = workspace(spark, "blocks")
    named_blocks(docs, length).write.parquet(path)
    place = spark.read.parquet(path)
    names = place.groupBy("name").agg(F.sum("anchors").alias("anchors")).where("anchors > 1").select("name")
    # Grouping by a struct deals the rows anew, so that the blocks of one name may lie in many tasks before and after.
    kinds = cut(
        place.join(names, "name", "left_semi").groupBy(F.struct("name", "content").alias("kind")).agg(
            F.min(F.struct("digest", "doc_id", "first", "last")).alias("one"), F.count(F.lit(1)).alias("copies"), F.max("anchors").alias("anchors")
        ).select("kind.name", "kind.content", "one", "copies", "anchors")
    )
    size = F.col("one.last") - F.col("one.first") + length
    # A table of its own, so that the join with it can split a name that has many kinds.
    per_name = cut(kinds.groupBy("name").agg(F.count(F.lit(1)).alias("kinds"), F.sum(size).alias("bytes")))
    # Equal blocks in several places repeat at each of their positions: only other kinds of the name need an array.
    judged = kinds.join(per_name, "name").withColumn("whole", F.col("copies") > 1)
    asked = judged.where("kinds > 1 or (anchors > 1 and not whole)").withColumn("shards", F.ceil(F.col("bytes") / SHARD_BYTES))
    asked = asked.select("name", "content", "one.*", "shards", F.pmod("content", "shards").alias("salt"))
    ask = cut(asked.groupBy("digest", "doc_id").agg(F.collect_list(F.struct("name", "content", "first", "last", "shards", "salt")).alias("asked")))
    bytes_ = F.expr(f"substring(raw, cast(a.first + 1 as int), cast(a.last - a.first + {length} as int))").alias("bytes")
    got = texts_of(ask, docs).select(F.explode("asked").alias("a"), "raw").select("a.name", "a.content", "a.shards", "a.salt", bytes_)
    span = "array<struct<first:bigint,last:bigint>>"
    dealt = got.repartition("name", "salt").sortWithinPartitions("name", "salt")
    marked = cut(dealt.mapInArrow(shard_task(length), f"name long, content long, spans {span}, run binary"))
    marks = marked.where("run is null").select("name", "content", "spans")
    if not marked.where("run is not null").isEmpty():
        marks = marks.join(across_shards(marked), ["name", "content"], "left").select(
            "name", "content", F.when(F.col("more").isNull(), F.col("spans")).otherwise(F.concat("spans", "more")).alias("spans")
        )
    verdict = judged.select("name", "content", "whole").join(marks, ["name", "content"], "left").where("whole or size(spans) > 0")
    moved = F.transform("spans", lambda s: F.struct((s["first"] + F.col("first")).alias("first"), (s["last"] + F.col("first")).alias("last")))
    all_of_it = F.array(F.struct(F.col("first").alias("first"), F.col("last").alias("last")))
    # Copies of a text have the same marks: one entry for each block of a distinct text.
    found = place.join(verdict, ["name", "content"]).groupBy("digest", "first").agg(
        F.first("last").alias("last"), F.first("whole").alias("whole"), F.first("spans").alias("spans")
    )
    found = found.select("digest", F.when(F.col("whole"), all_of_it).otherwise(moved).alias("spans"))
    found = cut(found.groupBy("digest").agg(F.flatten(F.collect_list("spans")).alias("spans")))
    remove(spark, path)
    return found


def removed(raw: bytes, marks, length: int) -> tuple[int, list[dict], bytes]:
    ends: list[tuple[int, int]] = []
    for s, e in sorted((m["first"], m["last"] + length) for m in marks or []):
        if ends and s <= ends[-1][1]:
            ends[-1] = (ends[-1][0], max(e, ends[-1][1]))
        else:
            ends.append((s, e))
    edges = [0, *(x for se in ends for x in se), len(raw)]
    return len(raw), [{"start": s, "end": e} for s, e in ends], b"".join(raw[s:e] for s, e in zip(edges[::2], edges[1::2]))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, spans array<struct<start,end>>, kept binary) for each row: maximal removed runs and what is left.

    A byte goes if a string of `length` bytes that covers it also begins anywhere else, the same text included;
    strings are judged on the input. Null and empty texts, and texts shorter than length, lose nothing.
    Repeated rows are copies of each other like any others. Extra columns are ignored.
    """
    found = repeated_positions(docs, length)
    held = docs.sparkSession.sparkContext.broadcast(bits_of(found, F.col("digest")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = ["doc_id", "n_bytes", "spans", "kept"]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = f"doc_id {kind}, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary"
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def batch(ids, results):
        n, spans, kept = zip(*results) if results else ((), (), ())
        return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], out)

    def untouched(batches):
        for b in sliced(batches):
            raws = [(t or "").encode("utf-8", "replace") for t in b.column(1).to_pylist()]
            keep = [i for i, r in enumerate(raws) if not in_bits(held.value, text_key(r))]
            yield batch(b.column(0).take(pa.array(keep, pa.int64())), [(len(raws[i]), [], raws[i]) for i in keep])

    def touched(batches):
        for b in sliced(batches):
            raws = [(t or "").encode("utf-8", "replace") for t in b.column(1).to_pylist()]
            keep = [i for i, r in enumerate(raws) if in_bits(held.value, text_key(r))]
            ids = b.column(0).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([text_key(raws[i]) for i in keep], pa.binary()), pa.array([raws[i] for i in keep], pa.binary())], ["doc_id", "digest", "raw"])

    def cut_out(batches):
        for b in sliced(batches):
            yield batch(b.column(0), [removed(raw, marks, length) for raw, marks in zip(b.column(1).to_pylist(), b.column(2).to_pylist())])

    changed = narrow.mapInArrow(touched, f"doc_id {kind}, digest binary, raw binary").join(found, "digest", "left")
    return narrow.mapInArrow(untouched, schema).unionByName(changed.select("doc_id", "raw", "spans").mapInArrow(cut_out, schema))


def op8_suffix_array_dedup(docs: DataFrame) -> DataFrame:
    """Sizes, spans and digest of what remove_repeats leaves of each row, and the text itself.

    text: the kept bytes as UTF-8, a replacement character where a removed run parts a character.
    """
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return remove_repeats(docs).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
    )
