"""Covering locality-sensitive hashing of 64-bit fingerprints.

Each bit is given a vector of radius + 1 bits. For each non-zero vector v a table masks the
fingerprint to the bits whose vector has an odd inner product with v. The vectors of any
`radius` bits leave some v orthogonal to all of them, so a pair that differs in those bits
alone agrees in v's table: every pair within the radius collides, none by chance. A bucket
with more than `most` fingerprints is covered again over the bits that its mask left out, until
its mask leaves at most 8 bits, which have 256 values; so no bucket is capped and no task holds
more than `most` of its rows.

A bucket sends on a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, stored

FULL = (1 << 64) - 1
RADIUS, MOST, SMALL = 2, 2048, 8


def covering(radius: int, over: int = FULL) -> list[int]:
    """2 ** (radius + 1) - 1 masks of the bits `over`: two words that differ in `radius` of them or fewer agree under some mask."""
    size = 1 << (radius + 1)
    bits = [b for b in range(64) if over >> b & 1]
    return [sum(1 << b for i, b in enumerate(bits) if bin((i % (size - 1) + 1) & v).count("1") % 2) for v in range(1, size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(ids: np.ndarray, fps: np.ndarray, limit: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the links (distance up to limit) among one bucket's rows, row by row: memory is linear."""
    left, a, b = np.arange(len(ids)), [], []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            j = front.pop()
            near = np.bitwise_count(fps[left] ^ fps[j]) <= limit
            new, left = left[near], left[~near]
            front += new.tolist()
            a += [ids[j]] * len(new)
            b += ids[new].tolist()
    return a, b


def links(nodes: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """nodes (node: long, fp: long, distinct) -> edges (a, b) among nodes whose fingerprints differ in `radius` bits or fewer.

    The edges' components are those of all such links.
    """
    small = SMALL

    def solve(last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Buckets in order of (t, k) in; links (t = -1) and the rows of too large buckets out."""

            def out(t, a, b) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(np.asarray(t, np.int32)), pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64))], ["t", "a", "b"])

            def linked(t: np.ndarray, k: np.ndarray, ids: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
                """Whole buckets. Small ones by shifted comparison, all at once; the others by search."""
                if not len(t):
                    return
                cuts = np.concatenate(([0], np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1, [len(t)]))
                sizes = np.diff(cuts)
                bucket = np.repeat(np.where(sizes <= small, np.arange(len(sizes)), -1), sizes)
                for shift in range(1, small):
                    at = np.flatnonzero((bucket[shift:] == bucket[:-shift]) & (bucket[shift:] >= 0))
                    at = at[np.bitwise_count(fps[at] ^ fps[at + shift]) <= radius]
                    if len(at):
                        yield out(np.full(len(at), -1), ids[at], ids[at + shift])
                for i in np.flatnonzero(sizes > small):
                    a, b = _forest(ids[cuts[i] : cuts[i + 1]], fps[cuts[i] : cuts[i + 1]], radius)
                    if a:
                        yield out(np.full(len(a), -1), a, b)

            held, big = None, None
            for batch in batches:
                t, k, ids = (np.asarray(batch.column(i)) for i in range(3))
                fps = np.asarray(batch.column(3)).view(np.uint64)
                if big is not None:  # what follows of a bucket already found too large
                    n = int(np.searchsorted(~((t == big[0]) & (k == big[1])), True))
                    yield out(t[:n], ids[:n], ids[:n])
                    t, k, ids, fps = t[n:], k[n:], ids[n:], fps[n:]
                    big = big if not len(t) else None
                if held is not None:
                    t, k, ids, fps = (np.concatenate(x) for x in zip(held, (t, k, ids, fps), strict=True))
                if not len(t):
                    continue
                cut = int(np.flatnonzero((t != t[-1]) | (k != k[-1]))[-1]) + 1 if (t[0], k[0]) != (t[-1], k[-1]) else 0
                full = slice(0, cut)
                if cut:
                    sizes = np.diff(np.concatenate(([0], np.flatnonzero((t[1:cut] != t[: cut - 1]) | (k[1:cut] != k[: cut - 1])) + 1, [cut])))
                    large = np.repeat(sizes > most, sizes) if not last else np.zeros(cut, bool)
                    if large.any():
                        yield out(t[full][large], ids[full][large], ids[full][large])
                    yield from linked(t[full][~large], k[full][~large], ids[full][~large], fps[full][~large])
                held = (t[cut:], k[cut:], ids[cut:], fps[cut:])
                if not last and len(t) - cut > most:
                    yield out(t[cut:], ids[cut:], ids[cut:])
                    big, held = (t[-1], k[-1]), None
            if held is not None:
                yield from linked(*held)

        return run

    n, found = partitions(nodes), None
    now, level = [(FULL, m) for m in covering(radius)], nodes.withColumn("t", F.lit(-1))  # of each table: the bits to cover, and its mask
    parents = [-1] * len(now)
    while True:
        last = all(bin(c & ~m).count("1") <= 8 for c, m in now)
        keys: dict[int, list] = {}
        for u, (parent, (_, m)) in enumerate(zip(parents, now, strict=True)):
            keys.setdefault(parent, []).append(F.struct(F.lit(u).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")))
        spread = level.select("node", "fp", F.explode(F.coalesce(*[F.when(F.col("t") == t, F.array(*x)) for t, x in keys.items()])).alias("x"))
        got = stored(spread.select("x.t", "x.k", "node", "fp").repartition(n, "t", "k").sortWithinPartitions("t", "k").mapInArrow(solve(last), "t int, a long, b long"))
        edges = got.where("t = -1").select("a", "b")
        found = edges if found is None else found.union(edges)
        hot = got.where("t >= 0").select("t", F.col("a").alias("node"))
        still = sorted(r[0] for r in hot.select("t").distinct().collect())  # a row for each table at most
        if not still:
            return found
        level = hot.join(nodes, "node")
        parents, deeper = [], []
        for t in still:  # cover over the bits that the mask of table t left out
            c, m = now[t]
            for x in covering(radius, c & ~m):
                parents.append(t)
                deeper.append((c & ~m, m | x))
        now = deeper
