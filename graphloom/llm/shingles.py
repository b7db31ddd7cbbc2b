"""Near duplicates: SimHash covering tables find most links, a prefix-filter join the rest, exact Jaccard decides.

A text is the set of its distinct k-word shingles, each known by 64 bits of hash; equal
sets are one node from the start. Candidates come from two searches:

1. SimHash: sets whose 64-bit fingerprints differ in two bits or fewer collide in a covering
   table (covering.py). That is linear work and joins up the large families of close copies.
   At similarity 4/5 fingerprints differ in about 10 of 64 bits, which no affordable covering
   reaches, hence
2. a prefix-filter join, which holds every pair at 4/5 and more: under any one order of all
   shingles, two such sets share one of their first n - ceil(4n/5) + 1 members. The order is by
   hash, with shingles that a sample of the documents shows to be common last (rarer ones
   first): the sample decides what a run costs, never what it finds.

A set's bitmap has a bit for each value of the last bits of its members' hashes, at least as
many bits as members: bits that one set has and the other lacks are as many members at least
that aren't shared, which rules most candidates out for certain. The others are verified on the whole sets.

Texts shuffle only if a pair to be verified has them, by a filter of at most 64 MB that loses none (a
filter too full lets more through, for the exact join after it), and once at the end, where rows are kept.

A large bucket first compares all its nodes to its least one. Where that and SimHash leave it in
more than one component, its pairs across components are compared in blocks of `block` nodes, so that
no task holds a whole bucket, and only pairs that their bitmaps allow leave a task. Each row knows the
first FIRST such buckets of its node: a pair leaves its first shared bucket and none that
follows one known to both, so that a large family sends its pairs about once. Pairs within
a component need no comparison: links only serve for components, which are those of all pairs
at 4/5 or more.

Defined results: texts without words are equal to each other only; rows of an equal or null
doc_id are told apart by their texts (64 bits of hash), and rows equal in both are one document;
an empty table gives no rows; whole texts are read, whatever their length; other columns aren't
looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, partitions, shared_folder, stored, swept, texts
from .components import components
from .covering import links
from .simhash import bits_of, majority

SHINGLE, SMALL, BLOCK = 5, 8, 1024
#: Shingles in OFTEN or more of one document in SAMPLE are common; the order knows COMMON of them at most.
SAMPLE, OFTEN, COMMON = 32, 8, 1 << 17
#: The filter of texts to be verified: bits a key, its bits, those of a segment.
PER_KEY, MOST_BITS, SEGMENT = 16, 1 << 29, 1 << 15
#: Earlier crowded buckets that a row knows of its node.
FIRST = 8


def shingles(text: str, k: int = SHINGLE) -> np.ndarray:
    """The hashes of the distinct k-word shingles, ascending. A text of fewer words is one shingle; one without words has none."""
    ws = text.encode().lower().split()  # bytes: only A-Z and the six ASCII spaces count
    if not ws:
        return np.empty(0, np.uint64)
    joined, width = b" ".join(ws), min(k, len(ws))
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n, digest = len(ws) - width + 1, xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, n))


def _node(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).view(np.int64))


def common(docs: DataFrame, k: int = SHINGLE) -> np.ndarray:
    """The common shingles of the sample, rarest first; COMMON of them at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, c = np.unique(np.concatenate([np.empty(0, np.uint64), *(shingles(t, k) for t in texts(b.column(0)))]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "c"])

    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("text")
    seen = sample.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= OFTEN)
    rows = seen.orderBy(F.desc("c"), "h").limit(COMMON).collect()
    return np.array([r.h for r in reversed(rows)], np.int64).view(np.uint64)


PRINTS = "doc_id long, th long, node long, n long, fp long, prefix array<long>, bits binary"


def prefixes(docs: DataFrame, late: np.ndarray, k: int = SHINGLE) -> DataFrame:
    """docs with doc_id, text -> doc_id, th (the text's hash), node (hash of the set), n (its size), fp (SimHash of the set), prefix (its first members, `late` ones last), bits."""
    rank = np.argsort(late)
    known, rank = late[rank], rank

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, sizes, prints, firsts, bits = [], [], [], [], []
            for t in texts(b.column(2)):
                found = shingles(t, k)
                nodes.append(_node(found))
                sizes.append(len(found))
                prints.append(bits_of(majority(found), len(found)))
                seen = np.zeros(max(1024, 1 << max(0, len(found) - 1).bit_length()), bool)
                seen[(found & np.uint64(len(seen) - 1)).astype(np.int64)] = True
                bits.append(np.packbits(seen).tobytes())
                length = len(found) - (4 * len(found) + 4) // 5 + 1 if len(found) else 0
                if len(known):
                    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                    last = known[at] == found
                    found = np.concatenate((found[~last], found[last][np.argsort(rank[at[last]])]))
                firsts.append(found[:length].view(np.int64))
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in firsts]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *firsts])))
            fp = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), fp, lists, pa.array(bits, pa.binary())], ["doc_id", "th", "node", "n", "fp", "prefix", "bits"])

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, PRINTS)


def possible(n: np.ndarray, i: np.ndarray, m: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets of n and m members that share their i-th and j-th may reach 4/5: 9 * shared >= 4 * (n + m)."""
    return 9 * (np.minimum(i, j) + np.minimum(n - i, m - j)) >= 4 * (n + m)


def _candidates(small: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (h, node, n, i) in order of (h, node) in; candidate pairs (i = -1: h, node) and the rows of buckets with over `small` out."""

        def out(h, node, n, i) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (h, node, n, i)], ["h", "node", "n", "i"])

        def pairs(a: tuple, b: tuple) -> Iterator[pa.RecordBatch]:
            ok = possible(a[2], a[3], b[2], b[3])
            x, y = a[1][ok], b[1][ok]
            if len(x):
                yield out(x, y, np.zeros(len(x), np.int64), np.full(len(x), -1, np.int64))

        def star(center: tuple, rows: tuple) -> Iterator[pa.RecordBatch]:
            yield out(*rows)
            yield from pairs(tuple(np.repeat(x, len(rows[0])) for x in center), rows)

        def whole(rows: tuple) -> Iterator[pa.RecordBatch]:
            h = rows[0]
            if not len(h):
                return
            starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            sizes = np.diff(np.concatenate((starts, [len(h)])))
            first, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
            for shift in range(1, small):
                at = np.flatnonzero((h[shift:] == h[:-shift]) & (size[shift:] <= small))
                yield from pairs(tuple(x[at] for x in rows), tuple(x[at + shift] for x in rows))
            large = size > small
            if large.any():
                yield out(*(x[large] for x in rows))
                large &= np.arange(len(h)) != first
                yield from pairs(tuple(x[first[large]] for x in rows), tuple(x[large] for x in rows))

        held, center = None, None
        for batch in batches:
            rows = tuple(np.asarray(batch.column(c)) for c in range(4))
            if center is not None:  # what follows of a bucket whose rows are no longer held
                n = int(np.searchsorted(rows[0], center[0][0], "right"))
                yield from star(center, tuple(x[:n] for x in rows))
                rows = tuple(x[n:] for x in rows)
                center = center if not len(rows[0]) else None
            if held is not None:
                rows = tuple(np.concatenate(x) for x in zip(held, rows, strict=True))
            if not len(rows[0]):
                continue
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            yield from whole(tuple(x[:cut] for x in rows))
            held = tuple(x[cut:] for x in rows)
            if len(held[0]) > small:
                yield from whole(held)
                center, held = tuple(x[:1] for x in held), None
        if held is not None:
            yield from whole(held)

    return run


def unshared(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many members of each set the other can't have, by rows of bitmaps (words of 64 bits) of one size."""
    return np.bitwise_count(x & ~y).sum(1, dtype=np.int64), np.bitwise_count(y & ~x).sum(1, dtype=np.int64)


def _folded(bitmaps: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps of fewer, `size`, words."""
    return np.bitwise_or.reduce(bitmaps.reshape(len(bitmaps), -1, size), axis=1)


def _bitmaps(found: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(found), np.uint64).reshape(len(found), -1)


def _across(rows: pa.Table) -> pa.Table:
    """The pairs of two blocks of a bucket (or of one with itself) that bitmaps allow, whose components differ and that share no bucket in `before`."""
    rows = rows.combine_chunks()
    node, n, i, root, own = (np.asarray(rows[c].combine_chunks()) for c in ("node", "n", "i", "root", "own"))
    bits, lo, hi = rows["bits"].to_pylist(), rows["lo"][0].as_py(), rows["hi"][0].as_py()
    words, before = np.array([len(x) for x in bits]) // 8, rows["before"].to_pylist()
    earlier = np.full((len(node), FIRST), rows["h"][0].as_py())  # filled up with this bucket, which is before no row here
    for x, hs in enumerate(before):
        earlier[x, : len(hs)] = hs
    left = np.flatnonzero(own == lo)
    classes = {w: np.flatnonzero((own == hi) & (words == w)) for w in np.unique(words)}
    # sets at 4/5 differ by a quarter in size, so that bitmaps are of one size or one is twice the other
    maps = {(w, v): _folded(_bitmaps([bits[y] for y in ys]), v) for w, ys in classes.items() if len(ys) for v in (w, w // 2) if v >= 16 or v == w}
    out: list[tuple] = []
    for x in left:
        for (w, v), all_y in maps.items():
            if v != min(words[x], w) or max(words[x], w) > 2 * min(words[x], w):
                continue
            ys = classes[w]
            at = np.flatnonzero((root[ys] != root[x]) & ((node[ys] > node[x]) if lo == hi else True) & possible(n[x], i[x], n[ys], i[ys]))
            if not len(at):
                continue
            mine, theirs = unshared(_folded(_bitmaps([bits[x]]), v), all_y[at])
            y = ys[at]
            y = y[9 * np.minimum(n[x] - mine, n[y] - theirs) >= 4 * (n[x] + n[y])]
            for h in before[x]:
                y = y[(earlier[y] != h).all(1)]
            if len(y):
                out.append((np.minimum(node[x], node[y]), np.maximum(node[x], node[y])))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 2
    return pa.table(dict(zip(("a", "b"), columns, strict=True)))


def _bounded(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that their bitmaps don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, m = np.asarray(batch.column("na")), np.asarray(batch.column("nb"))
            xa, xb = (batch.column(c).to_pylist() for c in ("xa", "xb"))
            sizes, most = np.array([(len(x), len(y)) for x, y in zip(xa, xb, strict=True)]) // 8, np.zeros(len(n), np.int64)
            for size in np.unique(sizes, axis=0):  # the larger bitmaps are folded to the size of the smaller
                at = np.flatnonzero((sizes == size).all(1))
                mine, theirs = unshared(*(_folded(_bitmaps([z[i] for i in at]), size.min()) for z in (xa, xb)))
                most[at] = np.minimum(n[at] - mine, m[at] - theirs)
            yield batch.select(["a", "b"]).filter(pa.array(9 * most >= 4 * (n + m)))

    one, two = (nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"x{c}")) for c in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "xa", "xb").mapInArrow(run, "a long, b long")


def _marks(keys: DataFrame, bits: int) -> bytes:
    """A filter with a bit for each key (long), of bits / 8 bytes."""

    def run(rows: pa.Table) -> pa.Table:
        marks = np.zeros(min(bits, SEGMENT), bool)
        marks[np.asarray(rows["at"].combine_chunks())] = True
        return pa.table({"segment": rows["segment"].slice(0, 1), "body": pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())})

    at = F.col("key").bitwiseAND(F.lit(bits - 1))
    found = keys.select(F.shiftright(at, SEGMENT.bit_length() - 1).alias("segment"), at.bitwiseAND(F.lit(SEGMENT - 1)).alias("at")).distinct().groupBy("segment").applyInArrow(run, "segment long, body binary")
    filled = bytearray(bits // 8)
    for segment, body in found.collect():  # bits / 8 bytes at most
        filled[segment * len(body) : (segment + 1) * len(body)] = body
    return bytes(filled)


def _marked(rows: DataFrame, marks) -> DataFrame:
    """The rows whose `key` has its bit in the broadcast filter: all that were marked, and a few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.frombuffer(marks.value, np.uint8)
        for b in batches:
            at = np.asarray(b.column("key")) & (8 * len(seen) - 1)
            yield b.filter(pa.array((seen[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))

    return rows.mapInArrow(run, rows.schema)


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have a similarity of 4/5 or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t, k) for t in texts(b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([_node(x) for x in found], pa.int64()), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], ["node", "members"])

    asked = stored(nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi").select("node", "least"))
    keys = asked.select(F.col("least.doc_id").alias("_id"), F.col("least.th").alias("_th")).distinct()
    bits = max(SEGMENT, min(MOST_BITS, 1 << (PER_KEY * asked.count()).bit_length()))
    marks = docs.sparkSession.sparkContext.broadcast(_marks(keys.select(F.xxhash64("_id", "_th").alias("key")), bits))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).withColumn("key", F.xxhash64("doc_id", "th"))
    read = _marked(rows, marks).join(keys, (F.col("th") == F.col("_th")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text")
    sets = stored(read.mapInArrow(run, "node long, members array<long>").join(asked.select("node"), "node", "left_semi").dropDuplicates(["node"]))
    marks.destroy()
    one, two = (sets.select(F.col("node").alias(c), F.col("members").alias(f"m{c}")) for c in "ab")
    shared = F.size(F.array_intersect("ma", "mb"))
    return stored(pairs.join(one, "a").join(two, "b").where(9 * shared >= 4 * (F.size("ma") + F.size("mb"))).select("a", "b"))


def _alike(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes by SimHash: of equal fingerprints, each with the least; of fingerprints within two bits, a spanning forest."""
    of = stored(nodes.groupBy("fp").agg(F.min("node").alias("rep")))
    same = nodes.join(of, "fp").where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    near = links(of.select(F.col("fp").alias("node"), "fp"))
    for c in "ab":
        near = near.join(of.select(F.col("fp").alias(c), F.col("rep").alias(f"r{c}")), c)
    return same.union(near.select(F.least("ra", "rb"), F.greatest("ra", "rb")))


def _rooted(docs: DataFrame, k: int, small: int, block: int) -> DataFrame:
    """docs with doc_id, text -> doc_id, th, root: the same for the texts of one component."""
    spark, folder = docs.sparkSession, f"{shared_folder(docs.sparkSession)}/prints-{uuid.uuid4().hex}"
    prefixes(docs, common(docs, k), k).write.parquet(folder)
    prints = spark.read.parquet(folder)
    nodes = stored(prints.groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("least"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits")))
    prints = stored(prints.select("doc_id", "th", "node"))
    delete(spark, folder)
    rows = nodes.select("node", "n", F.posexplode("prefix").alias("i", "h")).select("h", "node", "n", F.col("i").cast("long").alias("i"))
    got = stored(rows.repartition(partitions(docs), "h").sortWithinPartitions("h", "node").mapInArrow(_candidates(small), "h long, node long, n long, i long"))
    first = got.where("i < 0").select(F.col("h").alias("a"), F.col("node").alias("b")).union(_alike(nodes.select("node", "fp"))).distinct()
    bounded = stored(_bounded(first, nodes))
    swept(spark)
    found = _verified(bounded, docs, nodes, k)
    roots = components(found)
    crowded = got.where("i >= 0").join(roots, "node", "left").select("h", "node", "n", "i", F.coalesce("root", "node").alias("root"))
    mixed = crowded.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s")
    blocks = mixed.select("h", F.ceil(F.col("m") / block).alias("blocks"))
    own = crowded.join(blocks, "h").groupBy("node").agg(F.first("n").alias("n"), F.first("root").alias("root"), F.array_sort(F.collect_list(F.struct("i", "h", "blocks"))).alias("at"))
    own = own.join(nodes.select("node", "bits"), "node").select("node", "n", "root", "bits", "at", F.posexplode("at").alias("k", "x"))
    own = own.select("x.*", "node", "n", "root", "bits", F.slice("at.h", F.lit(1), F.least("k", F.lit(FIRST))).alias("before")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    spread = own.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("lo", F.least("own", "c")).withColumn("hi", F.greatest("own", "c"))
    # Members have one order in all prefixes, so that what precedes a bucket in both of two nodes' lists they share.
    across = spread.repartition(partitions(docs), "h", "lo", "hi").groupBy("h", "lo", "hi").applyInArrow(_across, "a long, b long")
    more = stored(across.distinct().join(first, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        found = found.union(_verified(more, docs, nodes, k))
        roots = components(found)
    return prints.select("doc_id", "th", "node").join(roots, "node", "left").select("doc_id", "th", F.coalesce("root", "node").alias("root"))


def near_groups(docs: DataFrame, k: int = SHINGLE, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """docs with doc_id, text -> doc_id, component_id (the smallest doc_id) over links of 4/5 similarity and more on k-word shingles."""
    rooted = stored(_rooted(docs, k, small, block))
    return rooted.join(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each near-duplicate group, with docs' own columns: that of the smallest doc_id (null last; of equal ones the smallest hash of text), and one of equal rows."""
    rooted = _rooted(docs.select("doc_id", "text"), SHINGLE, SMALL, BLOCK)
    least = rooted.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "th")).alias("x"))
    least = stored(least.select(F.col("x.none").alias("_none"), F.coalesce("x.doc_id", F.lit(0)).alias("_doc"), F.col("x.th").alias("_hash")))
    swept(docs.sparkSession)
    at = ["_none", "_doc", "_hash"]  # not null, so that the join and the choice of one row share one shuffle of the rows
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.isnull("doc_id").alias("_none"), F.coalesce("doc_id", F.lit(0)).alias("_doc"), F.xxhash64("text").alias("_hash"))
    return row.join(least, at, "left_semi").dropDuplicates(at).select("_row.*")
