"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints within the radius are found by covering tables (see covering.py): every such pair
collides in one. Equal fingerprints are one node from the start.

Defined results: a null or empty text, or one without words, has fingerprint 0, linked
like any other; rows with equal doc_id are fingerprinted one by one; an empty table
gives no rows; other columns aren't looked at; a null doc_id keeps a row and its
component's smallest id is that of the others (null if there are none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, texts
from .components import components
from .covering import MOST, RADIUS, links

SHINGLE = 3
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def majority(cells: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit."""
    cells, counts = cells.view(np.uint8).reshape(-1, 8), np.zeros(64, np.int64)
    if len(cells) < 256:
        return np.unpackbits(cells, axis=1, bitorder="little").sum(0, dtype=np.int64)
    for byte in range(8):
        counts[8 * byte : 8 * byte + 8] = np.bincount(cells[:, byte], minlength=256) @ _BITS
    return counts


def bits_of(counts: np.ndarray, n: int) -> int:
    """The fingerprint: a bit is set if over half of n hashes have it."""
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str, k: int) -> int:
    """64 majority bits over the XXH64 (seed 42) of the text's k-word shingles, repeats included."""
    ws = text.encode().lower().split()  # bytes: only A-Z and the six ASCII spaces count
    if not ws:
        return 0
    joined, k = b" ".join(ws), min(k, len(ws))
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    n, counts = len(ws) - k + 1, np.zeros(64, np.int64)
    for at in range(0, n, 1 << 20):
        st, en = starts[at : min(n, at + (1 << 20))].tolist(), ends[at + k - 1 : min(n, at + (1 << 20)) + k - 1].tolist()
        counts += majority(np.array([digest(joined[a:b], 42) for a, b in zip(st, en, strict=True)], np.uint64))
    return bits_of(counts, n)


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """docs with doc_id, text -> doc_id, fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.fromiter((fingerprint(t, k) for t in texts(b.column(1))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def groups(prints: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """prints (doc_id, fp: long) -> doc_id, fp, component_id: the smallest doc_id that links lead to."""
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes.select(F.col("fp").alias("node"), "fp"), radius, most))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(stored(fingerprints(table(spark, sf_dir, "documents"))))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op9_simhash": op9_simhash}
SQL: dict[str, str] = {}
