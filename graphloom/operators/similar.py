"""Dense vectors: a stated query set against a corpus, and similar pairs within pools. Both in blocks dealt to tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 8192  # vectors of one block


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    flat = np.asarray(column.flatten()).astype(np.float64)
    v = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(n == 0, 1.0, n)


def nearest(queries: DataFrame, corpus: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """queries and corpus (id, embedding) -> query_id, id, sim, rank: the k most alike, itself left out, ties to the smaller id.

    Each block of queries meets each block of the corpus in a task that keeps the best k of each query; those
    are merged by query. A task holds two blocks, and no vector passes through the driver.
    """
    parts = lambda df: max(1, -(-df.count() // block))
    n, m = parts(queries), parts(corpus)
    place = lambda own, many, other, other_many: (F.pmod(F.xxhash64("id"), F.lit(many)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(other_many - 1))).alias(other))
    q = queries.select("id", "embedding", *place("q", n, "c", m))
    c = corpus.select("id", "embedding", *place("c", m, "q", n))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, others = left["id"].to_numpy(), right["id"].to_numpy()
        if not len(ids) or not len(others):
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
        sims = _matrix(left["embedding"]) @ _matrix(right["embedding"]).T
        sims[ids[:, None] == others[None, :]] = -np.inf
        order = np.lexsort((np.broadcast_to(others, sims.shape), -sims), axis=1)[:, :k]
        best = np.take_along_axis(sims, order, 1)
        real = np.isfinite(best)
        return pa.table({"query_id": pa.array(np.broadcast_to(ids[:, None], best.shape)[real]), "id": pa.array(others[order][real]), "sim": pa.array(best[real])})

    found = q.groupBy("q", "c").cogroup(c.groupBy("q", "c")).applyInArrow(run, "query_id long, id long, sim double")
    return found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("sim"), "id"))).where(F.col("rank") <= k)


def similar_pairs(vectors: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """vectors (pool, id, embedding) -> pool, a, b, sim for a < b of one pool at the threshold or above.

    A pool is dealt into blocks of about `block` vectors, and each pair of its blocks to a task: every pair is compared,
    a task holds two blocks, and only pairs at the threshold leave it.
    """
    rows = vectors.select(F.col("pool").cast("string").alias("pool"), "id", "embedding")
    blocks = rows.groupBy("pool").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    own = rows.join(blocks, "pool").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    spread = own.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("pool", "id", "embedding", "own", F.least("own", "c").alias("lo"), F.greatest("own", "c").alias("hi"))

    def run(rows: pa.Table) -> pa.Table:
        rows, lo, hi = rows.sort_by("id"), rows["lo"][0].as_py(), rows["hi"][0].as_py()
        own, ids, v = rows["own"].to_numpy(), rows["id"].to_numpy(), _matrix(rows["embedding"])
        left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        a, b, s = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        for at in range(0, len(left), 1024):
            mine = left[at : at + 1024]
            sims = v[mine] @ v[right].T
            x, y = np.nonzero(sims >= threshold)
            p, q, w = ids[mine[x]], ids[right[y]], sims[x, y]
            keep = p < q if lo == hi else p != q
            a.append(np.minimum(p, q)[keep])
            b.append(np.maximum(p, q)[keep])
            s.append(w[keep])
        a, b, s = (np.concatenate(x) for x in (a, b, s))
        return pa.table({"pool": pa.array([rows["pool"][0].as_py()] * len(a), pa.string()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "sim": pa.array(s, pa.float64())})

    return spread.groupBy("pool", "lo", "hi").applyInArrow(run, "pool string, a long, b long, sim double")
