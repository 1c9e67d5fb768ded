"""Exact top-k inner products by a pivot-distance index.

Vectors are keyed by their nearest pivot and their distance to it, and sorted; runs of that order are annuli
(pivot, least and greatest distance, greatest norm). For a query q and an annulus around pivot p, the triangle
inequality keeps every member at least lb = max(0, d(q,p) - greatest, least - d(q,p)) away, so that no inner
product exceeds (|q|^2 + greatest norm^2 - lb^2) / 2. Each query goes through its annuli from the highest bound
down, in rounds that reach further each time; after each round its k-th best score so far is its floor, and it stops
where the next bound is below the floor.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Vectors that pivots are drawn from, pivots, least vectors of an annulus and most annuli of an index.
PIVOT_SAMPLE, PIVOTS, ANNULUS, MOST_ANNULI = 4096, 48, 1024, 20_000
#: Annuli of the first round, and how many times as many have been reached after each further one.
FIRST, FURTHER = 4, 8
#: What rounding may do to a bound, absolute and as a part of the squares in it.
SLACK, RELATIVE = 1e-6, 1e-9


def integers(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * component).

    Rows null or holding null, NaN or infinite components are left out. A finite component whose floor no long holds fails.
    """
    x = F.col("embedding").cast("array<double>")
    fits = lambda c: F.abs(c * F.lit(float(scale))) < F.lit(2.0**63)
    whole = F.transform(x, lambda c: F.when(fits(c), F.floor(c * F.lit(float(scale))).cast("long")).otherwise(F.raise_error(F.lit("a component's integer is beyond 64 bits"))))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return vectors.where("vec_id is not null and embedding is not null").where(fine).select("vec_id", whole.alias("v"))


def pivots(vecs: DataFrame) -> np.ndarray:
    """Farthest-first pivots of a bounded sample by hash; shorter vectors count as ending in zeros."""
    rows = vecs.orderBy(F.xxhash64("vec_id", F.lit("pivot")), "vec_id").limit(PIVOT_SAMPLE).select("v").collect()
    width = max((len(r.v) for r in rows), default=0)
    x = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        x[i, : len(r.v)] = r.v
    x = np.unique(x, axis=0)
    if not len(x):
        return x
    chosen, far = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(PIVOTS, len(x)):
        i = int(far.argmax())
        chosen.append(i)
        far = np.minimum(far, ((x - x[i]) ** 2).sum(1))
    return x[chosen]


def matrix(lists, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width), np.int64)
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products: floating point where it can't round, else whole numbers, of any size if need be."""
    top = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(x.astype(float)).max(initial=0)) * max(1, q.shape[1])
    if top < 2**24:
        return (q.astype(np.float32) @ x.astype(np.float32).T).astype(np.int64)
    if top < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T if top < 2**62 else q.astype(object) @ x.astype(object).T


def best_of_rows(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(row, id, score) of the k highest allowed scores of each row, ties to the smaller id."""
    r, c = np.nonzero(allowed)
    s = scores[r, c]
    _, high = np.unique(s, return_inverse=True)  # order of scores of any size
    order = np.lexsort((ids[c], -high, r))
    r, c, s = r[order], c[order], s[order]
    place = np.arange(len(r)) - np.searchsorted(r, r, "left")
    r, c, s = r[place < k], c[place < k], s[place < k]
    if len(s) and (s.max() >= 1 << 63 or s.min() < -(1 << 63)):
        raise OverflowError("a score among the highest is beyond 64 bits")
    return rows[r], ids[c], s.astype(np.int64)


def index(vecs: DataFrame, p: np.ndarray, width: int, size: int) -> DataFrame:
    """Annuli (annulus, pivot, least, most, norm2, ids binary, vectors binary) of at most `size` vectors.

    The order (pivot, distance, id) is range-partitioned, so a pivot or a single vector with a third of all
    rows lies in as many annuli and tasks as it needs.
    """
    held = vecs.sparkSession.sparkContext.broadcast(p)

    def near(batches):
        for b in batches:
            x = matrix(b.column(1).to_pylist(), width).astype(np.float64)
            d = np.stack([((x - q) ** 2).sum(1) for q in held.value], 1)
            i = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(i.astype(np.int32)), pa.array(np.sqrt(d[np.arange(len(i)), i]))], ["vec_id", "v", "pivot", "distance"])

    def annuli(batches):
        task = __import__("pyspark").TaskContext.get().partitionId()
        n, rows = 0, pd.DataFrame()

        def out(f):
            nonlocal n
            n += 1
            x = matrix(f["v"].tolist(), width)
            return {"annulus": (task << 32) | n, "pivot": int(f["pivot"].iloc[0]), "least": float(f["distance"].min()), "most": float(f["distance"].max()),
                    "norm2": float((x.astype(float) ** 2).sum(1).max()), "ids": f.vec_id.to_numpy(np.int64).tobytes(), "vectors": x.tobytes()}

        for f in batches:
            rows, ready = pd.concat([rows, f]) if len(rows) else f, []
            while len(rows):
                change = np.flatnonzero(rows["pivot"].to_numpy() != rows["pivot"].iloc[0])
                end = min(size, change[0] if len(change) else len(rows) + 1)
                if end > len(rows):
                    break
                ready.append(out(rows.iloc[:end]))
                rows = rows.iloc[end:]
            if ready:
                yield pd.DataFrame(ready)
        if len(rows):
            yield pd.DataFrame([out(rows)])

    keyed = vecs.mapInArrow(near, "vec_id long, v array<long>, pivot int, distance double")
    ordered = keyed.repartitionByRange("pivot", "distance", "vec_id").sortWithinPartitions("pivot", "distance", "vec_id")
    return ordered.mapInPandas(annuli, "annulus long, pivot int, least double, most double, norm2 double, ids binary, vectors binary")


def reaches(q: np.ndarray, p: np.ndarray, directory: np.ndarray) -> np.ndarray:
    """Upper bounds of each query's scores in each annulus."""
    of, least, most, norm2 = directory[:, 1].astype(int), directory[:, 2], directory[:, 3], directory[:, 4]
    q = q.astype(float)
    q2 = (q**2).sum(1)[:, None]
    to = np.sqrt(np.stack([((q - c) ** 2).sum(1) for c in p], 1))[:, of]
    lb = np.maximum(0, np.maximum(to - most, least - to) - SLACK - RELATIVE * (to + most))
    return np.minimum((q2 + norm2 - lb**2) / 2, np.sqrt(q2 * norm2)) + SLACK + RELATIVE * (q2 + norm2)


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vec_id divisible by `every` its k best other rows, ties to the smaller id.

    Null ids and rows with null or non-finite parts take no part. Of repeated ids each row is a candidate (never its own
    id's); of rows that repeat a query's id, the least vector asks. Shorter vectors count as ending in zeros. Scores are exact
    at any size; one among the highest that no long holds fails. Other columns are ignored. No vectors or one vector: no rows.
    """
    spark = vectors.sparkSession
    vecs = cut(integers(vectors, scale))
    total = vecs.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("w")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not total.n:
        return spark.createDataFrame([], schema)
    width, size = max(1, total.w), max(ANNULUS, total.n // MOST_ANNULI)
    p = pivots(vecs)
    p = np.pad(p, ((0, 0), (0, width - p.shape[1])))
    annuli = cut(index(vecs, p, width, size))
    # The directory has at most MOST_ANNULI rows and one for each pivot and task.
    directory = np.array([(r.annulus, r.pivot, r.least, r.most, r.norm2) for r in annuli.select("annulus", "pivot", "least", "most", "norm2").collect()])
    held = spark.sparkContext.broadcast((p, directory[np.argsort(directory[:, 0])]))
    best = spark.createDataFrame([], "query_id long, vec_id long, score long")
    asked = vecs.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("floor", F.lit(float("-inf")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    done, reached = 0, FIRST
    while True:

        def route(frames, done=done, reached=reached):
            """The queries of each annulus of this round, with their floors; queries that stop go nowhere."""
            ps, d = held.value
            names = d[:, 0].astype(np.int64)
            for f in frames:
                ids, q, floor = f.vec_id.to_numpy(np.int64), matrix(f.v.tolist(), width), f.floor.to_numpy(float)
                reach = reaches(q, ps, d)
                at = np.argsort(-reach, axis=1, kind="stable")[:, done:reached]
                r, c = np.nonzero(np.take_along_axis(reach, at, 1) >= floor[:, None])
                to = at[r, c]
                by = np.argsort(to, kind="stable")
                r, to = r[by], to[by]
                edges = np.flatnonzero(np.diff(to, prepend=-1, append=-1))
                rows = [{"annulus": int(names[to[s]]), "q_ids": ids[r[s:e]].tobytes(), "q": q[r[s:e]].tobytes(), "floors": floor[r[s:e]].tobytes()} for s, e in zip(edges[:-1], edges[1:])]
                if rows:
                    yield pd.DataFrame(rows)

        def search(frames):
            """The best k of each block of queries in one annulus, at or above the floor."""
            for f in frames:
                out = []
                for q_ids, q, floors, ids, raw in zip(f.q_ids, f.q, f.floors, f.ids, f.vectors):
                    q_ids, ids, floors = np.frombuffer(q_ids, np.int64), np.frombuffer(ids, np.int64), np.frombuffer(floors)
                    s = products(np.frombuffer(q, np.int64).reshape(-1, width), np.frombuffer(raw, np.int64).reshape(-1, width))
                    # As floating point numbers, a score and a floor may look equal but never change places.
                    out.append(best_of_rows(s, (s.astype(float) >= floors[:, None]) & (ids != q_ids[:, None]), ids, q_ids, k))
                query_id, vec_id, score = (np.concatenate(c) for c in zip(*out))
                yield pd.DataFrame({"query_id": query_id, "vec_id": vec_id, "score": score})

        routes = asked.mapInPandas(route, "annulus long, q_ids binary, q binary, floors binary")
        found = routes.join(annuli.select("annulus", "ids", "vectors"), "annulus").select("q_ids", "q", "floors", "ids", "vectors")
        found = found.mapInPandas(search, "query_id long, vec_id long, score long").unionByName(best)
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        done, reached = reached, reached * FURTHER
        if done >= len(directory):
            return ranked.select("query_id", "rank", "vec_id", "score")
        best = cut(ranked.select("query_id", "vec_id", "score"))
        floors = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("double").alias("kth")).where(F.col("n") >= k)
        asked = cut(asked.drop("floor").join(floors, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "v", F.coalesce("kth", F.lit(float("-inf"))).alias("floor")))


def op4_exact_topk(vectors: DataFrame) -> DataFrame:
    """The 20 best of each query, as top_k states it."""
    return top_k(vectors)
