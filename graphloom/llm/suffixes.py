"""Substring dedup over bytes by blockwise suffix sorting with a difference cover.

A block is the text around places that may repeat, dealt by anchors so that equal windows
share a block (spans.py finds the places and settles identical segments first). Within a
block the suffixes, to a depth of 100 bytes, are sorted one bucket of leading bytes at a
time, so that the keys in memory are those of one bucket. Bytes 0 to 20 and 79 to 99 are
compared as they are; between them the ranks of cover-sample suffixes, computed once a
block, stand for the rest of a long tie: {0, 1, 4, 14, 16} modulo 21 has every
difference, so that any two suffixes have a common shift under 21 to sampled places.

Defined results: a null text has no bytes; rows of an equal doc_id stand at one place, so
neither removes the other's bytes, but each loses what an earlier start in either covers;
a null doc_id is smaller than any other; an empty table gives no rows; texts of any
length are read whole, and no string crosses a document's end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, utf8
from .spans import Rule, remove

LENGTH, GRAM = 100, 24
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
BUCKET = 1 << 17  # suffixes sorted at a time, unless one 8-byte key has more

_TO_SAMPLE = np.array([min((d - r) % PERIOD for d in COVER) for r in range(PERIOD)])
_SHIFT = np.array([[next(s for s in range(PERIOD) if (a + s) % PERIOD in COVER and (b + s) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)])


def _words(data: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
    """The n bytes from each place as big-endian 64-bit keys; the last key may overlap the one before."""
    out = []
    for i in [*range(0, n - 7, 8), *([n - 8] if n % 8 else [])]:
        key = np.zeros(len(at), np.uint64)
        for j in range(8):
            key = key << np.uint64(8) | data[at + (i + j)]
        out.append(key)
    return out


def _ranks(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order, and for each row the rank of its keys among the distinct ones."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return order, rank


def sort_block(data: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Numbers of the windows data[i : i + length], i in start: equal numbers for equal windows."""
    if not len(start):
        return np.empty(0, np.int64)
    deep = length - PERIOD
    need = np.zeros(len(data) + 1, np.int32)
    np.add.at(need, start, 1)
    np.add.at(need, np.minimum(start + PERIOD, len(data)), -1)
    sample = np.flatnonzero((np.cumsum(need[:-1]) > 0) & np.isin(np.arange(len(data)) % PERIOD, COVER))
    sample = sample[sample + deep <= len(data)]
    rank = np.full(len(data), -1, np.int64)
    if len(sample):
        rank[sample] = _ranks(_words(data, sample, deep))[1]
    lead = _words(data, start, 8)[0]
    by_lead = np.argsort(lead, kind="stable")
    found, used, i = np.empty(len(start), np.int64), 0, 0
    while i < len(start):  # one bucket of leading bytes at a time
        j = min(i + BUCKET, len(start))
        j = int(np.searchsorted(lead[by_lead], lead[by_lead[j - 1]], side="right")) if j < len(start) else j
        rows = by_lead[i:j]
        at = start[rows]
        residue = at % PERIOD
        head, tail = _words(data, at, PERIOD), _words(data, at + deep, PERIOD)
        order, number = _ranks([*head, *tail, residue, rank[at + _TO_SAMPLE[residue]]])
        # windows that tie at both ends but stand at different residues: compare one of each class at their common shift
        first = order[np.searchsorted(number[order], np.arange(number.max() + 1))]
        same_as = np.arange(len(first))
        tie = np.zeros(len(first), bool)
        tie[1:] = np.logical_and.reduce([k[first[1:]] == k[first[:-1]] for k in (*head, *tail)])
        groups = np.cumsum(~tie)
        for g in np.unique(groups[tie]):
            seen: list[int] = []
            lo, hi = np.searchsorted(groups, [g, g + 1])
            for c in range(lo, hi):
                a = first[c]
                for s in seen:
                    b = first[s]
                    shift = _SHIFT[residue[a], residue[b]]
                    if residue[a] != residue[b] and rank[at[a] + shift] == rank[at[b] + shift]:
                        same_as[c] = s
                        break
                else:
                    seen.append(c)
        found[rows] = used + same_as[number]
        used += len(first)
        i = j
    return found


def solve(rule: Rule, bodies: pa.Array, doc: np.ndarray, first: np.ndarray, n: np.ndarray):
    """A block's windows by suffix sorting: a window repeats the first of its class in order of document and place."""
    data, offsets = utf8(bodies)
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = offsets[row] + at
    found, d, p = sort_block(data, start, rule.length), doc[row], first[row] + at
    order = np.lexsort((p, d, found))
    new = np.ones(len(order), bool)
    new[1:] = found[order][1:] != found[order][:-1]
    lead = np.empty(len(order), np.int64)
    lead[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]

    def digest(rows: np.ndarray) -> np.ndarray:
        raw = data.tobytes()
        return np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[i : i + rule.length]) for i in start[rows].tolist()]), np.int64).reshape(-1, 2)

    return row, at, rule.repeats(d, p, lead), digest


def drop_repeated_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs -> `row` (docs' own columns), n_units (bytes), n_removed, n_spans, kept (the bytes left). length > 2 * 21."""
    return remove(docs, Rule(length, gram, False, True, solve))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeated_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op3_suffix_dedup": op3_suffix_dedup}
SQL: dict[str, str] = {}
