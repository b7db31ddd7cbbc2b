"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs (lines, and long lines at words that a hash of the word
picks, so that a cut depends on nearby text only). The n-th copy of a paragraph has a
digest of its own: a document is a set. Each digest is added to one cell in each of
`HASHES` parts of a table; a cell holds how many, their digests' exclusive or, and the
exclusive or of a check. Two tables of one size subtract cell by cell; peeling cells that
hold one digest recovers what only one of the two has. The table's size follows the
text's own number of paragraphs, a power of two of cells: a larger table folds to a
smaller by adding its halves. If peeling sticks, both are built again twice as large.

The next document in order stands beside its predecessor because documents are dealt
by ranges of doc_id, and the first of a range is sent to the range before as well.

Defined results: a null or empty text has no paragraphs; two such have likeness 1, one
against another text 0; rows of an equal doc_id follow one another by text; a null
doc_id comes first; one document's next is itself; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from base64 import b64encode
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, table, texts

HASHES, LEAST_CELLS, CUT_EVERY = 3, 8, 8
_U = np.uint64
_SALTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def paragraphs(text: str) -> np.ndarray:
    """The distinct 64-bit digests of the text's paragraphs, the n-th copy of one under its own."""
    found: list[int] = []
    seen: dict[int, int] = {}
    digest, crc = xxhash.xxh3_64_intdigest, zlib.crc32
    for line in text.encode().split(b"\n"):
        ws = line.split()
        i = 0
        for j, w in enumerate(ws):
            if crc(w) % CUT_EVERY == 0 or j + 1 == len(ws):
                d = digest(b" ".join(ws[i : j + 1]))
                n = seen[d] = seen.get(d, -1) + 1
                found.append(d if not n else digest(d.to_bytes(8, "little"), seed=n))
                i = j + 1
    return np.array(found, _U)


def size_for(n: int) -> int:
    """Cells of each part for n digests: enough to peel a set of that many."""
    cells = LEAST_CELLS
    while HASHES * cells < 1.5 * n + 8:
        cells *= 2
    return cells


def _check(d: np.ndarray) -> np.ndarray:
    x = (d ^ (d >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    return (x ^ (x >> _U(29))) & _U(0xFFFFFFFF)


def _cells(d: np.ndarray, cells: int) -> np.ndarray:
    """(HASHES, n): a cell of each part. Folding a part in halves keeps the low bits."""
    return np.stack([((d * _U(s)) >> _U(24)) & _U(cells - 1) for s in _SALTS]).astype(np.int64) + (np.arange(HASHES) * cells)[:, None]


class Sketch:
    def __init__(self, count: np.ndarray, key: np.ndarray, check: np.ndarray):
        self.count, self.key, self.check = count, key, check

    @classmethod
    def of(cls, digests: np.ndarray, cells: int) -> Sketch:
        at = _cells(digests, cells).ravel()
        count = np.bincount(at, minlength=HASHES * cells)
        key, check = np.zeros(HASHES * cells, _U), np.zeros(HASHES * cells, _U)
        every = np.tile(digests, HASHES)
        np.bitwise_xor.at(key, at, every)
        np.bitwise_xor.at(check, at, _check(every))
        return cls(count, key, check)

    def text(self) -> str:
        """The table as a string; equal tables give equal strings."""
        return b64encode(zlib.compress(self.count.astype("<u4").tobytes() + self.key.astype("<u8").tobytes() + self.check.astype("<u4").tobytes(), 1)).decode()

    def fold(self, cells: int) -> Sketch:
        c, k, x = (a.reshape(HASHES, -1) for a in (self.count, self.key, self.check))
        while c.shape[1] > cells:
            h = c.shape[1] // 2
            c, k, x = c[:, :h] + c[:, h:], k[:, :h] ^ k[:, h:], x[:, :h] ^ x[:, h:]
        return Sketch(c.ravel(), k.ravel(), x.ravel())

    def peel(self, other: Sketch) -> tuple[np.ndarray, np.ndarray] | None:
        """The digests only self has and those only other has; None if peeling sticks."""
        count, key, check = self.count - other.count, self.key ^ other.key, self.check ^ other.check
        cells, mine, theirs = len(count) // HASHES, [], []
        while True:
            pure = np.flatnonzero((np.abs(count) == 1) & (_check(key) == check))
            if not len(pure):
                break
            d, first = np.unique(key[pure], return_index=True)
            sign = count[pure[first]]
            at = _cells(d, cells)
            whole = (at == pure[first]).any(0)  # a digest stands in its own cells
            d, sign, at = d[whole], sign[whole], at[:, whole].ravel()
            if not len(d):
                break
            np.subtract.at(count, at, np.tile(sign, HASHES))
            every = np.tile(d, HASHES)
            np.bitwise_xor.at(key, at, every)
            np.bitwise_xor.at(check, at, _check(every))
            mine.append(d[sign > 0])
            theirs.append(d[sign < 0])
        if count.any() or key.any() or check.any():
            return None
        none = np.empty(0, _U)
        return np.concatenate([none, *mine]), np.concatenate([none, *theirs])


def differences(pairs: list[tuple[Sketch, Sketch]]) -> list[tuple[int, int] | None]:
    """How many digests only the first and only the second of each pair have; None where peeling sticks. All pairs peel at once."""
    cells = np.array([len(a.count) // HASHES for a, _ in pairs])
    base = np.concatenate(([0], np.cumsum(cells * HASHES)))
    count = np.concatenate([a.count - b.count for a, b in pairs])
    key, check = np.concatenate([a.key ^ b.key for a, b in pairs]), np.concatenate([a.check ^ b.check for a, b in pairs])
    mine, theirs = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    at = np.flatnonzero(count)
    while len(at):
        at = at[(np.abs(count[at]) == 1) & (_check(key[at]) == check[at])]
        pair = np.searchsorted(base, at, side="right") - 1
        d, sign = key[at], count[at]
        mask = (cells[pair] - 1).astype(_U)
        own = np.stack([((d * _U(s)) >> _U(24)) & mask for s in _SALTS]).astype(np.int64) + np.arange(HASHES)[:, None] * cells[pair] + base[pair]
        whole = (own == at).any(0)  # a digest stands in its own cells
        pair, d, sign, own = pair[whole], d[whole], sign[whole], own[:, whole]
        order = np.lexsort((d, pair))  # a digest that stands alone in two cells counts once
        first = np.ones(len(order), bool)
        first[1:] = (d[order][1:] != d[order][:-1]) | (pair[order][1:] != pair[order][:-1])
        keep = order[first]
        pair, d, sign, own = pair[keep], d[keep], sign[keep], own[:, keep].ravel()
        mine += np.bincount(pair[sign > 0], minlength=len(pairs))
        theirs += np.bincount(pair[sign < 0], minlength=len(pairs))
        every = np.tile(d, HASHES)
        np.subtract.at(count, own, np.tile(sign, HASHES))
        np.bitwise_xor.at(key, own, every)
        np.bitwise_xor.at(check, own, _check(every))
        at = np.unique(own)
    left = np.add.reduceat((count != 0) | (key != 0) | (check != 0), base[:-1]) if len(pairs) else ()
    return [None if stuck else (int(a), int(b)) for stuck, a, b in zip(left, mine, theirs, strict=True)]


def likeness(pairs: list[tuple[np.ndarray, np.ndarray, Sketch, Sketch]]) -> list[float]:
    """|A and B| / |A or B| of pairs of digest sets, from the differences that their sketches peel to."""
    out, todo = [0.0] * len(pairs), []
    for n, (_, _, x, y) in enumerate(pairs):
        cells = min(len(x.count), len(y.count)) // HASHES
        todo.append((n, cells, x.fold(cells), y.fold(cells)))
    while todo:
        again = []
        for (n, cells, _, _), found in zip(todo, differences([(x, y) for _, _, x, y in todo]), strict=True):
            a, b, _, _ = pairs[n]
            if found is None:  # too many differences for so few cells
                again.append((n, 2 * cells, Sketch.of(a, 2 * cells), Sketch.of(b, 2 * cells)))
            else:
                both = len(a) - found[0]
                out[n] = both / (both + sum(found)) if both + sum(found) else 1.0
        todo = again
    return out


def ranges(docs: DataFrame) -> tuple[DataFrame, list[tuple[int, int | None]]]:
    """docs' doc_id, text, and the bucket of doc_id's range; and each bucket with its first doc_id, in order."""
    n = 4 * partitions(docs)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    edges = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 5 * n)).first()[0] or []
    spread = docs.sparkSession.sparkContext.broadcast(np.unique(np.array(edges, np.int64)))  # a number for each bucket

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(spread.value, ids.to_numpy(np.int64)).astype(np.int32))

    known = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("bucket", bucket(known))
    least = ids.withColumn("bucket", bucket(known)).groupBy("bucket").agg(F.min(known).alias("i"), F.bool_or(F.col("doc_id").isNull()).alias("null"))
    return keyed, [(b, None if null else i) for b, i, null in sorted(least.collect())]  # a row for each bucket


def compare(docs: DataFrame) -> DataFrame:
    """docs with doc_id, text -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its second half (rounded down) replaced by as
    many characters of the next document, or all it has.
    """
    keyed, firsts = ranges(docs)
    places = [b for b, _ in firsts]
    back = {i: places[k - 1] for k, (_, i) in enumerate(firsts)}  # a bucket's first document also goes to the bucket before
    spark = docs.sparkSession
    heads = F.broadcast(spark.createDataFrame([(i, b) for i, b in back.items()], "head long, before int"))  # a row for each bucket
    own = keyed.select("bucket", F.lit(0).alias("extra"), "doc_id", "text")
    head = keyed.join(heads, keyed.doc_id.eqNullSafe(F.col("head"))).groupBy(F.col("before").alias("bucket"), "doc_id").agg(F.min("text").alias("text"))
    dealt = own.union(head.select("bucket", F.lit(1).alias("extra"), "doc_id", "text"))
    dealt = dealt.repartition(partitions(docs), "bucket").sortWithinPartitions("bucket", "extra", F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        before, rows, pairs = None, [], []  # before: (bucket, doc_id, text, digests, sketch) of the row that waits for its next

        def flush() -> pa.RecordBatch:
            near = likeness(pairs)
            columns = [*zip(*rows, strict=True), near[::2], near[1::2]]
            rows.clear()
            pairs.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names)

        size = 0
        for b in batches:
            for place, extra, i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), texts(b.column(3)), strict=True):
                digests = paragraphs(t)
                now = (place, i, t, digests, Sketch.of(digests, size_for(len(digests))))
                if before is not None and before[0] == place:
                    _, j, old, d, sketch = before
                    half = len(old) // 2
                    edited = old[: len(old) - half] + t[:half]
                    e = paragraphs(edited)
                    changed = Sketch.of(e, size_for(len(e)))
                    rows.append((j, len(old), hashlib.sha256(edited.encode()).hexdigest(), sketch.text(), changed.text()))
                    pairs += [(d, e, sketch, changed), (d, digests, sketch, now[4])]
                    size += len(old) + len(t)
                before = None if extra else now
                if size > 1 << 21:
                    yield flush()
                    size = 0
        if rows:
            yield flush()

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(table(spark, sf_dir, "documents"))


QUERIES = {"op7_fingerprints": op7_fingerprints}
SQL: dict[str, str] = {}
