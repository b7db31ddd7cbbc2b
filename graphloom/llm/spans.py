"""Finding and removing what long repeats cover, for byte and for word sequences.

A window is `length` consecutive units of one document. Its anchor is the first gram (of
`gram` units) of least hash in it, so that equal windows have equal anchors. A segment is
a run of windows whose anchor is at one place.

1. Every segment goes to its anchor as (digest, document, place). Segments of equal
   digest are settled there: all windows of a later one are repeats. Anchors with one
   segment have no repeats. A task settles what it can before it sends anything: it
   sends an anchor's digest once, and the segments of an anchor that already differ in
   that task skip the anchor (a mark goes in their place), so that an anchor gets a few
   rows from each task at most, however common its text is.
2. First segments of anchors with several digests are looked at window by window: their text
   goes to its anchor, where a block of whole anchors at a time finds its equal windows. An
   anchor with more than CROWD segments, or more text than a block, is dealt over several
   blocks; the windows that such a block can't settle meet at their 128-bit digests.
3. Each text gets its repeats by its key and loses what they cover. The join reads the
   same dealt documents as step 2's: the texts shuffle once.

A text's key is its doc_id and 64 bits of its hash: rows of an equal (or null) doc_id are told
apart by their texts, and rows that are equal in both share one key and one result.
Ranges are packed in a long: 32 bits of the first window, 8 of the number of windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions, pieces, stored, texts, utf8

RUN = 128  # windows of a segment at most
HELD = 400_000  # segments that a task settles at once
CROWD, SALTS = 1024, 64  # segments of an anchor in one block; parts of a join on common anchors
BLOCK = 1 << 21  # bytes of text whose windows are settled together
_U = np.uint64
_rng = np.random.default_rng(20240607)
BYTE_CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
BASE = int(_rng.integers(1, 1 << 62)) * 4 + 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int, _kept: dict = {}) -> np.ndarray:  # noqa: B006
    """base ** i for i < n, modulo 2 ** 64."""
    if len(_kept.get(base, ())) < n:
        made = np.full(max(n, 1 << 12), base, _U)
        made[0] = 1
        _kept[base] = np.multiply.accumulate(made)
    return _kept[base][:n]


def prefix(codes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(codes) + 1, _U)
    np.cumsum(codes * powers(BASE, len(codes)), out=out[1:])
    return out


def spread_bits(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def hashes(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Of the units start to stop, wherever they stand."""
    return spread_bits((sums[stop] - sums[start]) * powers(BASE_INVERSE, len(sums))[start])


@dataclass(frozen=True)
class Units:
    """Texts as units: their codes, and where each text's begin (len + 1)."""

    codes: np.ndarray
    bounds: np.ndarray


def byte_units(data: np.ndarray, offsets: np.ndarray) -> Units:
    return Units(BYTE_CODES[data], offsets)


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word and the byte after its last. A text's edge ends a word."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.concatenate(([False], inside[:-1])), np.concatenate((inside[1:], [False]))
    return np.flatnonzero(inside & (~before | edge[:-1])), np.flatnonzero(inside & (~after | edge[1:])) + 1


def word_units(data: np.ndarray, offsets: np.ndarray) -> Units:
    if not len(data):
        return Units(np.empty(0, _U), np.zeros(len(offsets), np.int64))
    first, last = word_places(data, offsets)
    return Units(hashes(prefix(BYTE_CODES[data]), first, last) | _U(1), np.searchsorted(first, offsets))


def _grams(codes: np.ndarray, gram: int, sums: np.ndarray | None = None) -> np.ndarray:
    """Hash of the gram at each place, for texts of at least one gram."""
    sums = prefix(codes) if sums is None else sums
    return spread_bits((sums[gram:] - sums[:-gram]) * powers(BASE_INVERSE, len(codes) - gram + 1))


def segments(u: Units, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """anchor, digest, first window (a unit's number), windows of each segment."""
    n, none = len(u.codes), np.empty(0, np.int64)
    starts = np.zeros(n + 1, np.int32)
    long = np.diff(u.bounds) >= length
    np.add.at(starts, u.bounds[:-1][long], 1)
    np.add.at(starts, u.bounds[1:][long] - length + 1, -1)
    valid = np.cumsum(starts[:n]).astype(bool)
    if not valid.any():
        return none.view(_U), none.view(_U), none, none
    sums = prefix(u.codes)
    grams = _grams(u.codes, gram, sums)
    w = length - gram + 1
    padded = np.full(-(-(len(grams) + w) // w) * w, np.iinfo(_U).max, _U)
    low = _U((1 << 28) - 1)  # the leftmost of equal grams: a run has one place as its anchor, so no two of its windows are equal
    padded[: len(grams)] = grams & ~low | np.arange(len(grams), dtype=_U) & low
    blocks = padded.reshape(-1, w)
    up, down = np.minimum.accumulate(blocks, axis=1).ravel(), np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - length + 1
    least = np.minimum(down[:count], up[w - 1 : w - 1 + count])
    valid = valid[:count]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    first = np.flatnonzero(new)
    text = np.searchsorted(u.bounds, first, side="right") - 1
    stop = np.minimum(np.concatenate((first[1:], [count])), u.bounds[text + 1] - length + 1)
    size = stop - first
    if (size > RUN).any():
        parts = -(-size // RUN)
        at = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, size = np.repeat(first, parts) + at * RUN, np.minimum(np.repeat(size, parts) - at * RUN, RUN)
    anchor = first + (((least[first] & low).astype(np.int64) - first) & int(low))
    return grams[anchor], hashes(sums, first, first + size + length - 1), first, size


def pack(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    return first << 8 | size - 1


def unpack(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x >> 8 & 0xFFFFFFFF, (x & 0xFF) + 1


NAMES = ["kind", "r", "s", "doc", "tag", "place"]
ROWS = "kind byte, r long, s long, doc long, tag long, place long"
OPEN, SURE, LOOK, MARK = 0, 1, 2, 3  # to be settled; repeats for sure; to be looked at by window; "this anchor has several digests"


def _batch(kind, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(kind, np.int8))] + [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in columns], NAMES)


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """True where sorted rows differ from the row before."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _apart(place: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Where rows go that no group waits for."""
    return spread_bits(place.view(_U) * _U(31) + doc.view(_U))


@dataclass(frozen=True)
class Rule:
    """length and gram in units. same_doc: whether an earlier window of the same document counts.

    solve(rule, bodies, doc, first, n) settles a block: bodies hold n windows each, from a
    document's window `first` on. It gives row, window within it and whether it repeats, for all
    windows, and a function that names the windows of given numbers by 128 bits.
    """

    length: int
    gram: int
    words: bool
    same_doc: bool
    solve: Callable

    def units(self, data: np.ndarray, offsets: np.ndarray) -> Units:
        return word_units(data, offsets) if self.words else byte_units(data, offsets)

    def repeats(self, doc: np.ndarray, place: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Which rows repeat the first of their group. first: its row number for each row."""
        return (doc > doc[first]) | (self.same_doc & (doc == doc[first]) & (place > place[first]))


def _send(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def settle() -> Iterator[pa.RecordBatch]:
            a, s, doc, tag, place = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((tag, place, doc, s, a))
            order = order[_first_of(*(x[order] for x in (a, s, doc, tag, place)))]  # equal rows of one key
            a, s, doc, tag, place = (x[order] for x in (a, s, doc, tag, place))
            new_a, new = _first_of(a), _first_of(a, s)
            first = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
            again = rule.repeats(doc, place, first)
            group = np.cumsum(new_a) - 1
            mixed = (np.bincount(group, weights=new) > 1)[group]
            kind = np.where(again, SURE, np.where(mixed, LOOK, OPEN))
            waits = kind == OPEN
            yield _batch(kind, np.where(waits, a, _apart(place, doc)), np.where(waits, s, a), doc, tag, place)  # the others keep their anchor as s
            marks = new_a & mixed
            if marks.any():
                yield _batch(np.full(marks.sum(), MARK), a[marks], s[marks], doc[marks], tag[marks], place[marks])

        n = 0
        for b in batches:
            for i, j in pieces(b, 2):
                part = b.slice(i, j - i)
                u = rule.units(*utf8(part.column(2)))
                a, s, first, size = segments(u, rule.length, rule.gram)
                if not len(a):
                    continue
                text = np.searchsorted(u.bounds, first, side="right") - 1
                held.append((a, s, np.asarray(part.column(0))[text], np.asarray(part.column(1))[text], pack(first - u.bounds[text], size)))
                n += len(a)
                if n > HELD:
                    yield from settle()
                    n = 0
        if held:
            yield from settle()

    return run


MET = "kind byte, r long, doc long, tag long, place long"


def _meet(rule: Rule, windows: bool):
    """Sorted by r, s, doc, place: settles each anchor (or each window digest). What is to be looked at leaves with its anchor as r."""

    def settle(rows: list[tuple]) -> pa.RecordBatch | None:
        kind, r, s, doc, tag, place = (np.concatenate(x) for x in zip(*rows, strict=True))
        through = (kind == SURE) | (kind == LOOK)
        out = [tuple(x[through] for x in (kind, s, doc, tag, place))]
        rest = np.flatnonzero(~through)
        rest = rest[_first_of(*(x[rest] for x in (kind, r, s, doc, tag, place)))]  # equal rows of one key
        kind, r, s, doc, tag, place = (x[rest] for x in (kind, r, s, doc, tag, place))
        if len(r):
            real = kind == OPEN
            group = np.cumsum(_first_of(r)) - 1
            marked = np.bincount(group, weights=~real) > 0
            r, s, doc, tag, place, group = (x[real] for x in (r, s, doc, tag, place, group))
            if len(r):
                new = _first_of(r, s)
                first = np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))
                again = rule.repeats(doc, place, first)
                mixed = (marked | (np.bincount(group, weights=new, minlength=len(marked)) > 1))[group]
                out.append((np.full(again.sum(), SURE), *(x[again] for x in (r, doc, tag, place))))
                look = ~again & mixed & (not windows)
                out.append((np.full(look.sum(), LOOK), *(x[look] for x in (r, doc, tag, place))))
        kind, *columns = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int8)), *map(pa.array, columns)], ["kind", "r", "doc", "tag", "place"]) if len(kind) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the rows of one r
        for b in batches:
            now = tuple(np.asarray(c) for c in b.columns)
            if not len(now[0]):
                continue
            cut = int(np.searchsorted(now[1], now[1][-1]))
            if cut or held and held[0][1][0] != now[1][0]:
                if out := settle([*held, *([tuple(x[:cut] for x in now)] if cut else [])]):
                    yield out
                held = []
            held.append(tuple(x[cut:] for x in now))
        if held and (out := settle(held)):
            yield out

    return run


CUT = "q long, final boolean, doc long, tag long, place long, body binary"


def _cut(rule: Rule):
    """Texts with segments to look at -> the segments' units as bytes, for the anchor (or the part of one) that they go to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            held = 0

            def batch(out=out) -> pa.RecordBatch:
                kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["q", "final", "doc", "tag", "place", "body"])

            for doc, tag, t, ranges in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b.column(2)), b.column(3), strict=True):
                if (doc, tag) == last:  # equal rows stand together: one of them speaks for all
                    continue
                last, body = (doc, tag), t.encode()
                body = body.split() if rule.words else body
                found = ranges.values
                q, final, place = (found.field(c) for c in ("q", "final", "place"))
                first, size = unpack(np.asarray(place))
                for k, (i, n) in enumerate(zip(first.tolist(), size.tolist(), strict=True)):
                    part = body[i : i + n + rule.length - 1]
                    if len(part) < n + rule.length - 1:  # not this text's: another of the same key
                        continue
                    part = b" ".join(part) if rule.words else part
                    for column, x in zip(out, (q[k].as_py(), final[k].as_py(), doc, tag, place[k].as_py(), part), strict=True):
                        column.append(x)
                    held += len(part)
                if held > 1 << 22:
                    yield batch()
                    held = 0
                    for x in out:
                        x.clear()
            if out[0]:
                yield batch()

    return run


def _at_anchor(rule: Rule, block: int):
    """Segments in order of q -> repeats. A block holds whole anchors; the parts of one that outgrows it are not final."""

    def settle(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        final, doc, tag, place = (np.concatenate([x[i] for x in rows]) for i in range(1, 5))
        first, n = unpack(place)
        row, at, again, digest = rule.solve(rule, pa.concat_arrays([x[5] for x in rows]), doc, first, n)
        d, t, p = doc[row], tag[row], first[row] + at
        if again.any():  # consecutive windows as one range
            gone = np.flatnonzero(again)
            gone = gone[np.lexsort((p[gone], t[gone], d[gone]))]
            dg, tg, pg = d[gone], t[gone], p[gone]
            new = _first_of(dg, tg, pg - np.arange(len(pg)))
            new |= (np.arange(len(pg)) - np.maximum.accumulate(np.where(new, np.arange(len(pg)), 0))) % RUN == 0
            head = np.flatnonzero(new)
            ranges = pack(pg[head], np.diff(np.concatenate((head, [len(pg)]))))
            yield _batch(np.full(len(head), SURE), _apart(ranges, dg[head]), ranges, dg[head], tg[head], ranges)
        rest = np.flatnonzero(~again & ~final[row])
        if len(rest):
            ids = digest(rest)
            yield _batch(np.full(len(rest), OPEN), ids[:, 0], ids[:, 1], d[rest], t[rest], pack(p[rest], np.ones(len(rest), np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (q, final, doc, tag, place, body) columns
        size, large = 0, None
        of = lambda part: pc.sum(pc.binary_length(part[5])).as_py() or 0
        for b in batches:
            q, final, doc, tag, place = (np.array(b.column(i)) for i in range(5))
            if large is not None:
                final &= q != large
            for i, j in pieces(b, 5, block):
                held.append((q[i:j], final[i:j], doc[i:j], tag[i:j], place[i:j], b.column(5).slice(i, j - i).cast(pa.large_binary()).cast(pa.binary())))
                size += of(held[-1])
                if size < block:
                    continue
                last = q[j - 1]
                if held[0][0][0] == last:  # one anchor fills the block
                    for x in held:
                        x[1][:] = False
                    final[j:] &= q[j:] != last
                    yield from settle(held)
                    held, size, large = [], 0, last
                    continue
                cuts = [int(np.count_nonzero(x[0] != last)) for x in held]  # the last anchor's rows stand at the end
                yield from settle([tuple(y[:c] for y in x) for x, c in zip(held, cuts, strict=True) if c])
                held = [tuple(y[c:] for y in x) for x, c in zip(held, cuts, strict=True) if c < len(x[0])]
                size = sum(map(of, held))
        if held:
            yield from settle(held)

    return run


def _by_key(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy("doc", "tag").agg(F.collect_list(F.struct(*columns) if len(columns) > 1 else F.col(columns[0])).alias("ranges"))


def repeats(docs: DataFrame, rule: Rule, block: int = BLOCK, crowd: int = CROWD) -> DataFrame:
    """docs (row, doc: long, tag: long, text) -> (doc, tag, ranges): packed window ranges that repeat earlier text, a row for each key with any."""
    n = partitions(docs)
    met = docs.select("doc", "tag", "text").mapInArrow(_send(rule), ROWS).repartition(n, "r").sortWithinPartitions("r", "s", "doc", "place", "tag")
    found = stored(met.mapInArrow(_meet(rule, False), MET))
    # an anchor that is common everywhere has rows from every task: its rows learn how many there are in SALTS parts
    look = found.where(F.col("kind") == LOOK).select("r", "doc", "tag", "place", F.pmod(F.xxhash64("doc", "tag"), F.lit(SALTS)).cast("int").alias("salt"))
    crowds = look.groupBy("r").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("r", F.ceil(F.col("n") / crowd).alias("parts"))
    crowds = crowds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = look.join(crowds, ["r", "salt"], "left")
    part = F.xxhash64("r", F.pmod(F.xxhash64("doc", "tag"), F.col("parts")))
    dealt = dealt.select("doc", "tag", "place", F.coalesce(part, F.col("r")).alias("q"), F.isnull("parts").alias("final"))
    # `row` isn't read here: with it both joins read one exchange of the documents
    cut = docs.join(_by_key(dealt, "q", "final", "place"), ["doc", "tag"]).select("doc", "tag", "text", "ranges", "row").mapInArrow(_cut(rule), CUT)
    window = cut.repartition(n, "q").sortWithinPartitions("q", "doc", "tag", "place").mapInArrow(_at_anchor(rule, block), ROWS)
    window = window.repartition(n, "r").sortWithinPartitions("r", "s", "doc", "place", "tag").mapInArrow(_meet(rule, True), MET)
    return _by_key(found.where(F.col("kind") == SURE).select("doc", "tag", "place").union(window.select("doc", "tag", "place")), "place")


def keyed(docs: DataFrame) -> DataFrame:
    """docs with doc_id, text -> row (the other columns), doc (null: the smallest), tag, text (null: empty)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"),
        F.xxhash64(text).alias("tag"),
        text.alias("text"),
    )


def covered(ranges: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs of units that the windows cover, in order."""
    first, size = unpack(ranges)
    order = np.argsort(first, kind="stable")
    first, stop = first[order], (first + size + length - 1)[order]
    reach = np.maximum.accumulate(stop)
    new = np.concatenate(([True], first[1:] > reach[:-1]))
    return list(zip(first[new].tolist(), reach[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(first) - 1]))].tolist(), strict=True))


def remove(docs: DataFrame, rule: Rule) -> DataFrame:
    """docs -> `row` (docs' own columns but text), n_units, n_removed, n_spans, kept (binary).

    kept: what is left of the bytes, or of the words joined by a space.
    """
    rows = keyed(docs)
    both = rows.join(repeats(rows, rule), ["doc", "tag"], "left").select("row", "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            units, removed, spans, kept = [], [], [], []
            for t, ranges in zip(texts(b.column(1)), b.column(2), strict=True):
                body = t.encode()
                body = body.split() if rule.words else body
                gone = covered(np.asarray(ranges.values), rule.length) if ranges.is_valid else []
                gone = [(i, j) for i, j in gone if j <= len(body)]
                left, at = [], 0
                for i, j in gone:
                    left.append(body[at:i])
                    at = j
                left.append(body[at:])
                units.append(len(body))
                removed.append(sum(j - i for i, j in gone))
                spans.append(len(gone))
                kept.append(b" ".join([w for x in left for w in x]) if rule.words else b"".join(left))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (units, removed, spans)), pa.array(kept, pa.binary())], ["row", "n_units", "n_removed", "n_spans", "kept"])

    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), *(T.StructField(c, T.LongType()) for c in ("n_units", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType())])
    return both.mapInArrow(run, schema)
