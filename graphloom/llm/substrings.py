"""Substring dedup by relative Lempel-Ziv parsing over words.

The reference is every document with a smaller doc_id. It is dealt into blocks by content: an
anchor (see spans.py) of every window, the document's own and the reference's, decides which
block may hold its copy, so that each document is parsed against every block that can match it
and none is compared with all. A segment that equals an earlier one word for word is one
factor, known by its digest. The others are parsed in their block: the block's suffixes are
sorted, and each segment is factored greedily from left to right, a factor being the longest
match with any text of a smaller doc_id in the block (or one word that has none). Factors of
50 words or more are duplicate spans. A copy may begin within one factor and end in the next:
the windows across each boundary of two factors are looked up in the same index.

Defined results: a null text has no words; rows of an equal doc_id don't remove each
other's words; a null doc_id is smaller than any other; an empty table gives no rows;
whole texts are read, whatever their length.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, utf8
from .spans import Rule, keyed, remove, repeats, word_units

WINDOW, GRAM = 50, 8


def _ranks(codes: np.ndarray, bounds: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Ranks of the 1, 2, 4, ... words at each place of the texts, each ended by a mark of its own, and each text's first place.

    The last ranks order all suffixes.
    """
    sizes, many = np.diff(bounds), len(bounds) - 1
    starts = bounds[:-1] + np.arange(many)
    rank = np.empty(len(codes) + many, np.int64)
    text = np.repeat(np.arange(many), sizes)
    rank[np.arange(len(codes)) + text] = np.unique(codes, return_inverse=True)[1] + many
    rank[bounds[1:] + np.arange(many)] = np.arange(many)
    out, width = [rank], 1
    while width <= sizes.max(initial=0):
        after = np.concatenate((rank[width:], np.full(min(width, len(rank)), -1)))
        rank = np.unique(rank * (len(rank) + 1) + after + 1, return_inverse=True)[1]
        out.append(rank)
        width *= 2
    return out, starts


def _before(keys: list[int]) -> list[int]:
    """For each place the last place before it with a smaller key; -1 if there is none."""
    out, open_ = [], []
    for i, x in enumerate(keys):
        while open_ and keys[open_[-1]] >= x:
            open_.pop()
        out.append(open_[-1] if open_ else -1)
        open_.append(i)
    return out


def _common(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words the suffixes at a and b have in common."""
    a, b, n = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        same = ranks[k][a] == ranks[k][b]  # never beyond a text's end: its mark is its own
        n[same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    return n


def longest_matches(codes: np.ndarray, bounds: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each word of each text, how long the longest match from it on is with a text of a smaller doc.

    In the order of suffixes that match is with the nearest suffix of a smaller doc on one side or the other.
    """
    if not len(codes):
        return np.empty(0, np.int64)
    ranks, starts = _ranks(codes, bounds)
    order = np.argsort(ranks[-1])
    _, level = np.unique(doc, return_inverse=True)
    of = np.repeat(level, np.diff(bounds) + 1)
    keys = of[order]
    down, up = np.array(_before(keys.tolist())), len(keys) - 1 - np.array(_before(keys[::-1].tolist()))[::-1]
    found = np.zeros(len(order), np.int64)
    for near, there in ((down, down >= 0), (up, up < len(keys))):
        at = np.flatnonzero(there)
        found[order[at]] = np.maximum(found[order[at]], _common(ranks, order[at], order[near[at]]))
    words = np.ones(len(order), bool)
    words[bounds[1:] + np.arange(len(starts))] = False
    return found[words]


def greedy_factors(longest: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, length) of each factor, all texts' next factors at a time; a word without a match is a factor of one."""
    at, first, size = bounds[:-1].copy(), [], []
    while (now := at < bounds[1:]).any():
        first.append(at[now])
        size.append(np.maximum(longest[at[now]], 1))
        at[now] += size[-1]
    if not first:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first, size = np.concatenate(first), np.concatenate(size)
    order = np.argsort(first)
    return first[order], size[order]


def repeated_windows(longest: np.ndarray, bounds: np.ndarray, length: int) -> np.ndarray:
    """Which places begin a repeated window: those within a factor, and across the boundaries of factors those that the index has."""
    n = len(longest)
    first, size = greedy_factors(longest, bounds)
    inside, across = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    wide = size >= length
    np.add.at(inside, first[wide], 1)
    np.add.at(inside, first[wide] + size[wide] - length + 1, -1)
    np.add.at(across, np.maximum(first - length + 1, 0), 1)
    np.add.at(across, first, -1)
    return (np.cumsum(inside[:n]) > 0) | (np.cumsum(across[:n]) > 0) & (longest >= length)


def solve(rule: Rule, bodies: pa.Array, doc: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, Callable]:
    """A block's windows by relative Lempel-Ziv parsing of its segments."""
    data, offsets = utf8(bodies)
    u = word_units(data, offsets)
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    again = repeated_windows(longest_matches(u.codes, u.bounds, doc), u.bounds, rule.length)[u.bounds[row] + at]

    def digest(rows: np.ndarray) -> np.ndarray:
        texts, out = {}, []
        for r, i in zip(row[rows].tolist(), at[rows].tolist(), strict=True):
            if r not in texts:
                texts[r] = bodies[r].as_py().split()
            out.append(xxhash.xxh3_128_digest(b" ".join(texts[r][i : i + rule.length])))
        return np.frombuffer(b"".join(out), np.int64).reshape(-1, 2)

    return row, at, again, digest


def _rule(window: int, gram: int) -> Rule:
    return Rule(window, gram, True, False, solve)


def long_factors(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs -> (doc_id, first_word, n_words): the duplicate spans, overlapping where segments do. A span of over 127 + window words is in parts."""
    rows = keyed(docs)
    spans = repeats(rows.select("row", "doc", "tag", "text"), _rule(window, gram)).select("doc", F.explode("ranges").alias("p"))
    doc = F.when(F.col("doc") != F.lit(-(1 << 63)), F.col("doc"))
    return spans.select(doc.alias("doc_id"), F.shiftright("p", 8).alias("first_word"), (F.col("p").bitwiseAND(F.lit(255)) + window).alias("n_words"))


def drop_repeated_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs -> `row` (docs' own columns), n_units (words), n_removed, n_spans, kept (the words left, joined by a space)."""
    return remove(docs, _rule(window, gram))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op10_substring_dedup": op10_substring_dedup}
SQL = {
    "op10_substring_dedup": r"""
    with ws as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents),
    win as (select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as h from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from ws where len(w) >= 50)),
    firsts as (select h, min(doc_id) as d from win group by h),
    gone as (select distinct doc_id, unnest(range(i, i + 50)) as p from win join firsts using (h) where d < doc_id),
    words as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as p from ws),
    kept as (select words.doc_id, string_agg(x, ' ' order by words.p) filter (gone.p is null) as k, count(gone.p) as n_removed from words left join gone on words.doc_id = gone.doc_id and words.p = gone.p group by words.doc_id)
    select doc_id, len(w)::BIGINT as n_words, coalesce(n_removed, 0)::BIGINT as n_removed, sha256(coalesce(k, '')) as kept_sha256 from ws left join kept using (doc_id)"""
}
