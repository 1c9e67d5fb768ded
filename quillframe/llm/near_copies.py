"""Near copies: SimHash groups completed to all texts whose sets of word shingles have a Jaccard similarity of 0.8 or more.

1. The fingerprints of operator 9 (here over the distinct five-word shingles) are linked by their Golay keys, and each
   link is verified on the whole sets. That finds the closest copies: a bit differs with a probability of
   acos(2 J / (1 + J)) / pi, which is 0.15 at a similarity J of 0.8, some ten bits of 64, beyond any radius of few keys.
2. Prefixes find the rest without losing a pair: of two sets that similar, ordered alike, the first n - ceil(0.8 n) + 1
   shingles of each have one in common. Shingles found often in a sample of texts are ordered last, so that common lines
   seldom are in a prefix, and before them those of frequent words, which texts share by chance; the order has no part in
   the result. Candidates are verified on the whole sets.

Pairs within a group are not all drawn: a shingle of many texts links them to a centre, round by round, and then only pairs
between components are drawn. A shingle with few pairs left has them drawn at once and takes no part in later rounds.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import components, cut, give_back, remove, sliced, small, tidy, workspace
from .simhash import links as fingerprint_links

WORDS, SIMILARITY = 5, 0.8
#: Texts and shingles of the sample that orders the shingles: bounds of its cost, with no part in the result.
SAMPLE, OFTEN, HEAVY = 8_000, 4, 200_000
#: The sample is at least one text in so many, so that shingles it misses have few texts whatever the size of the corpus.
SHARE = 32
#: Bins of word hashes whose weights order the shingles.
WORD_BINS = 1 << 16
#: Bits that tell wanted texts from others.
NODE_BITS = 1 << 24
#: Most rounds of links to centres (one that doesn't halve the pairs left is the last), and pairs a prefix row up to which all pairs, of a shingle or of all of them, are drawn at once.
STARS, FEW = 6, 4
PAIR = "a long, b long"
#: Marks the row of a text that holds its fingerprint.
FINGERPRINT = -1


def word_hashes(text: str | None) -> np.ndarray:
    split = (text or "").encode("utf-8", "replace").lower().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, split), np.uint64, len(split))


def weighed_shingles(text: str | None, words: int = WORDS, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of a text's word shingles, and the sum of the weights of each one's words; a shorter text is one
    shingle, one without words is zero."""
    w = word_hashes(text)
    if not len(w):
        return np.zeros(1, np.uint64), np.zeros(1, np.int64)
    n = max(1, len(w) - words + 1)
    h, weight = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    of = np.zeros(len(w), np.int64) if weights is None else weights[(w & np.uint64(len(weights) - 1)).astype(np.int64)]
    for i in range(min(words, len(w))):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + n]
        weight += of[i : i + n]
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    h, at = np.unique(h ^ (h >> np.uint64(31)), return_index=True)
    return h, weight[at]


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    return weighed_shingles(text, words)[0]


def fingerprint(sh: np.ndarray) -> int:
    """64-bit SimHash of a set of hashes, as a signed number."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(sh), 65536):
        votes += np.unpackbits(sh[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(sh), bitorder="little").view("<i8")[0])


def exact(similarity: float) -> Fraction:
    return Fraction(similarity).limit_denominator(1000)


def noded(docs: DataFrame) -> DataFrame:
    """(doc_id, node, text): equal texts are one node."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("node"), text.alias("text"))


def frequent(texts: DataFrame, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a sample: shingles that several texts have, sorted, and in how many; and weights of words, by bins of their hashes."""

    def run(batches):
        for b in sliced(batches):
            out = [shingles(t, words) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64))], ["sh"])

    def histogram(batches):
        for b in sliced(batches):
            out = [np.zeros(0, np.uint64), *map(word_hashes, b.column(1).to_pylist())]
            bins, n = np.unique(np.concatenate(out) & np.uint64(WORD_BINS - 1), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bins.view(np.int64)), pa.array(n)], ["bin", "n"])

    share = min(max(1, texts.count() // SAMPLE), SHARE)
    sample = texts.where(F.pmod("node", F.lit(share)) == 0)
    found = sample.mapInArrow(run, "sh long").groupBy("sh").count().where(F.col("count") >= OFTEN)
    t = found.orderBy(F.desc("count"), "sh").limit(HEAVY).toArrow()
    sh, n = t.column("sh").to_numpy().view(np.uint64), t.column("count").to_numpy()
    order = np.argsort(sh)
    t = sample.mapInArrow(histogram, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    weights = np.zeros(WORD_BINS, np.int64)
    weights[t.column("bin").to_numpy()] = 4 * np.log2(1 + t.column("n").to_numpy())
    return sh[order], n[order], weights


def prefixes(texts: DataFrame, often: tuple[np.ndarray, np.ndarray, np.ndarray], words: int, least: Fraction) -> DataFrame:
    """(sh, node, at): the fingerprint of each text (at is FINGERPRINT), and its first shingles; at then holds the text's number
    of shingles and the place, 32 bits each."""
    held = texts.sparkSession.sparkContext.broadcast(often)

    def run(batches):
        heavy, count, weights = held.value
        for b in sliced(batches):
            out = [(np.zeros(0, np.int64),) * 3]
            for node, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sh, weight = weighed_shingles(t, words, weights)
                n = len(sh)
                out.append((np.array([fingerprint(sh)]), np.array([node]), np.array([FINGERPRINT])))
                known = 0
                if len(heavy):
                    i = np.minimum(np.searchsorted(heavy, sh), len(heavy) - 1)
                    known = np.where(heavy[i] == sh, count[i], 0)
                sh = sh[np.lexsort((sh, weight, known + np.zeros(n, np.int64)))]
                p = n - -(-least.numerator * n // least.denominator) + 1
                out.append((sh[:p].view(np.int64), np.full(p, node, np.int64), n << 32 | np.arange(p)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["sh", "node", "at"])

    return texts.mapInArrow(run, "sh long, node long, at long")


def possible(x: str, y: str, least: Fraction) -> F.Column:
    """By their sizes and the places of a first common shingle, two sets may be similar."""
    size = lambda c: F.shiftright(F.col(c), 32)
    rest = lambda c: size(c) - F.col(c).bitwiseAND(0xFFFFFFFF)
    p, q = least.numerator, least.denominator
    sizes = q * F.least(size(x), size(y)) >= p * F.greatest(size(x), size(y))
    return sizes & ((p + q) * F.least(rest(x), rest(y)) >= p * (size(x) + size(y)))


def counts(sh: np.ndarray) -> np.ndarray:
    """How many shingles fall in each of 2^k bins, about three a bin: a small upper bound for overlaps."""
    bins = 1 << max(0, (len(sh) // 4).bit_length())
    while (n := np.bincount((sh & np.uint64(bins - 1)).astype(np.int64), minlength=bins)).max() > 255:
        bins *= 2
    return n.astype(np.uint8)


def may_be_similar(x: np.ndarray, y: np.ndarray, least: Fraction) -> bool:
    x, y = x.astype(np.int64), y.astype(np.int64)
    bins = min(len(x), len(y))
    both = np.minimum(x.reshape(-1, bins).sum(0), y.reshape(-1, bins).sum(0)).sum()
    return bool(least.denominator * both >= least.numerator * (x.sum() + y.sum() - both))


def similar(x: np.ndarray, y: np.ndarray, least: Fraction) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return bool(least.denominator * both >= least.numerator * (len(x) + len(y) - both))


def of_nodes(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts of the wanted nodes. Where those are too many to broadcast, bits of them first keep most other texts from the shuffle."""
    if (n := wanted.count()) <= common.BROADCAST_ROWS:
        return texts.join(F.broadcast(wanted), "node", "left_semi")
    bins = wanted.select(F.pmod("node", F.lit(NODE_BITS)).alias("h")).selectExpr("h div 64 as word", "shiftleft(1L, cast(h % 64 as int)) as bit")
    t = bins.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(NODE_BITS // 64, np.int64)
    bits[t.column("word").to_numpy()] = t.column("bits").to_numpy()
    held = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for b in batches:
            h = b.column(0).to_numpy() % NODE_BITS
            yield b.filter(pa.array((held.value[h >> 6] >> (h & 63) & 1).astype(bool)))

    return texts.mapInArrow(run, "node long, text string").join(small(wanted, n), "node", "left_semi")


def verified(pairs: DataFrame, texts: DataFrame, words: int, least: Fraction, saved) -> DataFrame:
    """The pairs (a, b) of similar texts; whole sets are made and move only for those that counts by bins leave."""

    def check(judge, kind):
        def run(batches):
            for b in sliced(batches):
                x, y = ([np.frombuffer(s, kind) for s in c.to_pylist()] for c in b.columns[2:])
                yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array([judge(*p, least) for p in zip(x, y)], pa.bool_()))

        return run

    def beside(pairs, of):
        def sets(batches):
            for b in sliced(batches):
                out = [of(shingles(t, words)).tobytes() for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["node", "of"])

        wanted = saved(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct())
        found = saved(of_nodes(texts, wanted).mapInArrow(sets, "node long, of binary").dropDuplicates(["node"]))
        a, b = (found.select(F.col("node").alias(c), F.col("of").alias(d)) for c, d in ("ax", "by"))
        return pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y")

    give_back(pairs.sparkSession)
    left = saved(beside(pairs, counts).mapInArrow(check(may_be_similar, np.uint8), PAIR))
    return saved(beside(left, np.asarray).mapInArrow(check(similar, np.uint64), PAIR))


def near_copies(texts: DataFrame, folder: str, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(node, root) of the texts that have a near copy: root names the component of links of similar texts.

    Tables between rounds go to folder: checkpoints keep the constraints of their plans, which grow from round to round.
    """
    spark, names, least = texts.sparkSession, [], exact(similarity)

    def saved(df):
        names.append(path := f"{folder}/{len(names)}")
        df.write.parquet(path)
        schema = df.schema
        del df
        tidy(spark)
        return spark.read.schema(schema).parquet(path)

    def linked(pairs):
        """The similar ones of the pairs; tables that only led to them, sets among these, go at once."""
        at = len(names)
        found = verified(pairs, texts, words, least, saved)
        for path in names[at:-1]:
            remove(spark, path)
        return found

    first = saved(prefixes(texts, frequent(texts, words), words, least))
    fps = saved(first.where(F.col("at") == FINGERPRINT).select(F.col("sh").alias("fp"), "node").distinct())
    one = saved(fps.groupBy("fp").agg(F.min("node").alias("one")))
    equal = fps.join(one, "fp").where(F.col("node") != F.col("one")).select(F.col("one").alias("a"), F.col("node").alias("b"))
    ends = [one.select(F.col("fp").alias(c), F.col("one").alias(f"of_{c}")) for c in "ab"]
    near = fingerprint_links(one).join(ends[0], "a").join(ends[1], "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    tested = saved(equal.union(near))
    links = linked(tested)
    roots = saved(components(links))
    # Only shingles of several texts matter.
    rows = first.where(F.col("at") != FINGERPRINT)
    several = rows.groupBy("sh").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("sh")
    rows = saved(rows.join(several, "sh", "left_semi").distinct())
    total, now = rows.count(), float("inf")
    for k in range(STARS + 1):
        give_back(spark)
        of = saved(rows.join(roots, "node", "left").select("sh", "node", "at", F.coalesce("root", "node").alias("c")))
        # A text with few shingles of its own before a common one is near the middle of its group.
        place = F.col("at").bitwiseAND(0xFFFFFFFF) if k == 0 else F.lit(0)
        centre = F.min(F.struct(place.alias("place"), F.xxhash64("node", F.lit(k)).alias("h"), "node", "at", "c")).alias("m")
        sizes = of.groupBy("sh", "c").agg(F.count("*").cast("double").alias("n"), centre)
        sizes = sizes.groupBy("sh").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"), F.min("m").alias("m"))
        pairs_left = (F.col("n") * F.col("n") - F.col("same")) / 2
        left = sizes.where(pairs_left > 0).select("sh", "n", pairs_left.alias("left"), F.col("m.node").alias("node_"), F.col("m.at").alias("at_"), F.col("m.c").alias("c_"))
        left = saved(left)
        before, now = now, left.agg(F.sum("left")).first()[0] or 0
        last = k == STARS or now <= FEW * total or 2 * now > before
        left = left.select("sh", (F.lit(not last) & (F.col("left") > FEW * F.col("n"))).alias("many"), "node_", "at_", "c_")
        stars = of.join(left.where("many"), "sh")
        rest = of.join(left.where("not many").select("sh"), "sh", "left_semi")
        other = rest.select("sh", F.col("node").alias("node_"), F.col("at").alias("at_"), F.col("c").alias("c_"))
        drawn = []
        for some in (stars, rest.join(other, "sh").where("node < node_")):
            some = some.where((F.col("c") != F.col("c_")) & possible("at", "at_", least))
            drawn.append(some.select(F.least("node", "node_").alias("a"), F.greatest("node", "node_").alias("b")))
        pairs = saved(drawn[0].union(drawn[1]).distinct().join(tested, ["a", "b"], "left_anti"))
        if not pairs.isEmpty():
            found = linked(pairs)
            links, tested = links.union(found), tested.union(pairs)
            roots = saved(components(links))
        if last:
            return roots
        # Shingles of which all pairs were drawn are done; only the large ones go on to the next round.
        rows = saved(rows.join(left.where("many").select("sh"), "sh", "left_semi"))


def drop_near_copies(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group of near copies, with all its columns: that of the smallest doc_id (nulls last).

    A group is a component of links between texts whose distinct shingles (words lower-cased in A-Z) reach the similarity;
    texts with fewer words are one shingle, null texts count as empty, and texts without words are copies of each other.
    Where the smallest doc_id has several texts of a group, one of them stays, and one of rows that are repeated; other rows
    of that doc_id, in other groups, are judged on their own. Extra columns, whatever their names, have no part in it.
    Texts are told apart by 64-bit hashes. An empty table stays empty.
    """
    spark, folder = docs.sparkSession, workspace(docs.sparkSession, "near-copies")
    texts = noded(docs)
    keys = cut(texts.select("doc_id", "node").groupBy("doc_id", "node").agg(F.count("*").alias("n")))
    roots = near_copies(texts.select("node", "text"), folder, words, similarity)
    named = keys.join(roots, "node", "left").select("doc_id", "node", "n", F.coalesce("root", "node").alias("root"))
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "node")
    best = named.groupBy("root").agg(F.min(order).alias("best"), F.sum("n").alias("rows")).where("rows > 1").select("root", "best.doc_id", "best.node")
    best = best.toDF("root", "keep_id", "keep_node")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("node") == F.col("keep_node"))
    judged = cut(named.join(best, "root").select(F.col("doc_id").alias("__id"), F.col("node").alias("__of"), kept.alias("kept"), "n"))
    remove(spark, folder)
    gone, again = judged.where("not kept").select("__id", "__of"), judged.where("kept and n > 1").select("__id", "__of")
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__node") == F.col("__of"))
    rest = docs.withColumn("__node", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))).join(small(gone), on, "left_anti")
    if (n := again.count()):
        once = rest.join(small(again, n), on, "left_semi").dropDuplicates(["doc_id", "__node"])
        rest = rest.join(small(again, n), on, "left_anti").unionByName(once)
    return rest.drop("__node")
