"""Line dedup with two Bloom filters, for once-seen and twice-seen line hashes.

1. The 128-bit digests of each document's line keys are written once, dealt by hash into as
   many parts as keep ten filter bits for each line within `most_bits` a part.
2. Part by part: each task sends the filter bits of its own keys, a segment of the filter at a
   time. A bit that is set once goes to the once filter, and to the twice filter if it is set
   again, in this task or another. So a key of two documents always has its bits in the twice
   filter; a key of one has them by accident only. Only that filter is broadcast (64 MB at most).
3. Only digests that the twice filter suspects shuffle. Counting exact 128-bit digests
   settles which keys enough documents hold and which document keeps them.
4. What each text loses goes to it by its doc_id and its hash.

The filters work alike at every size: more lines make more parts, never a larger or no filter.

Defined results: a null or empty text is one empty line; a null doc_id counts for no
key and loses its copies; rows of an equal doc_id are one document to the counts and
each loses the lines on its own; whole texts are read, whatever their length.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import delete, shared_folder, stored, table, texts

MIN_CHARS, MIN_DOCS, SALTS = 20, 3, 16
PER_LINE, MOST_BITS, SEGMENT, MOST_PARTS = 10, 1 << 29, 1 << 19, 1 << 15  # bits; parts are told by 15 bits of the digest


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The line without the six ASCII spaces at its ends, A-Z lower-cased; None if it is shorter than min_chars code points."""
    key = line.strip().lower()
    if len(key) < min_chars or not key.isascii() and len(key.decode()) < min_chars:
        return None
    return key


def digests(text: str, min_chars: int) -> set[bytes]:
    keys = {line_key(x, min_chars) for x in text.encode().split(b"\n")}
    return {xxhash.xxh3_128_digest(k) for k in keys if k is not None}


DIGESTS = "doc_id long, th long, hi long, lo long"


def _cells(found: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)


def line_digests(docs: DataFrame, min_chars: int, parts: int) -> DataFrame:
    """(doc_id, th, hi, lo, part): each text's distinct line digests. th: the text's hash; part: which of `parts` by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(digests(t, min_chars)) for t in texts(b.column(2))]
            rows = pa.array(np.repeat(np.arange(b.num_rows), [len(x) for x in found]))
            cells = _cells([d for x in found for d in x])
            part = cells[:, 0] >> 48 & (parts - 1)
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(cells[:, 0]), pa.array(cells[:, 1]), pa.array(part.astype(np.int32))], ["doc_id", "th", "hi", "lo", "part"])

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, f"{DIGESTS}, part int")


def _bits(batch: pa.RecordBatch, bits: int) -> list[np.ndarray]:
    """The two filter bits of each digest."""
    return [np.asarray(batch.column(c)) & (bits - 1) for c in ("hi", "lo")]


def twice_seen(found: DataFrame, bits: int) -> bytes:
    """The twice filter of the digests, of bits / 8 bytes."""
    segment = min(bits, SEGMENT)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            """The bits of the keys held; one that several of them set is sent twice."""
            at, n = np.unique(np.concatenate(held), return_counts=True)
            at = np.repeat(at, np.minimum(n, 2))
            first = np.flatnonzero(np.concatenate(([True], at[1:] // segment != at[:-1] // segment)))
            body = [zlib.compress(np.diff(x, prepend=0).astype(np.uint32).tobytes(), 1) for x in np.split(at % segment, first[1:])]
            return pa.RecordBatch.from_arrays([pa.array((at[first] // segment).astype(np.int32)), pa.array(body, pa.binary())], ["segment", "body"])

        for b in batches:
            held += _bits(b, bits)
            if sum(map(len, held)) > 2_000_000:
                yield out()
                held.clear()
        if sum(map(len, held)):
            yield out()

    def merge(rows: pa.Table) -> pa.Table:
        seen = np.zeros(segment, np.uint8)
        for x in rows["body"].to_pylist():
            at, n = np.unique(np.cumsum(np.frombuffer(zlib.decompress(x), np.uint32)), return_counts=True)
            seen[at] = np.minimum(seen[at] + n, 2)
        return pa.table({"segment": rows["segment"].slice(0, 1), "twice": pa.array([zlib.compress(np.packbits(seen == 2, bitorder="little").tobytes(), 1)], pa.binary())})

    merged = found.select("hi", "lo").mapInArrow(send, "segment int, body binary").groupBy("segment").applyInArrow(merge, "segment int, twice binary")
    filled = bytearray(max(1, bits // 8))
    for number, twice in merged.collect():  # bits / 8 bytes at most
        part, at = zlib.decompress(twice), number * segment // 8
        filled[at : at + len(part)] = part
    return bytes(filled)


def suspected(found: DataFrame, bits: int) -> DataFrame:
    """The digests whose bits the twice filter has, stored."""
    spread = found.sparkSession.sparkContext.broadcast(twice_seen(found, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.frombuffer(spread.value, np.uint8)
        for b in batches:
            hit = np.ones(b.num_rows, bool)
            for at in _bits(b, bits):
                hit &= (seen[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            yield b.filter(pa.array(hit))

    out = stored(found.select("doc_id", "th", "hi", "lo").mapInArrow(run, DIGESTS))
    spread.destroy()
    return out


def suspects(docs: DataFrame, min_chars: int, most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, th, hi, lo): each text's line digests that the filters can't rule out, stored."""
    spark = docs.sparkSession
    lines = docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 0
    need = 1 << (PER_LINE * lines).bit_length()
    parts = min(max(1, need // most_bits), MOST_PARTS)
    folder = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    line_digests(docs, min_chars, parts).write.partitionBy("part").parquet(folder)
    every, found = spark.read.schema(f"{DIGESTS}, part int").parquet(folder), None
    for part in range(parts):
        one = suspected(every.where(F.col("part") == part), max(8, need // parts))
        found = one if found is None else found.union(one)
    delete(spark, folder)
    return found


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, most_bits: int = MOST_BITS) -> DataFrame:
    """docs -> `row` (docs' own columns), `kept` (the text without its dropped lines), n_lines, n_dropped.

    A key of min_chars code points or more that min_docs documents hold loses its
    lines in all of them but the largest doc_id.
    """
    found = suspects(docs, min_chars, most_bits)
    shared = found.groupBy("hi", "lo").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs).drop("n")
    # A very common line has a row in a third of all documents: each key is joined in SALTS parts.
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "th"), F.lit(SALTS)).cast("int"))
    shared = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    lost = salted.join(shared, ["hi", "lo", "salt"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_set(F.struct("hi", "lo")).alias("lost"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text", F.xxhash64("text").alias("th"))
    both = row.join(lost, (F.col("th") == F.col("_th")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("row", "text", "lost")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, lines, dropped = [], [], []
            for t, gone in zip(texts(b.column(1)), b.column(2).to_pylist(), strict=True):
                n, all_lines = 0, None
                if gone:
                    gone = {np.array([g["hi"], g["lo"]], np.int64).tobytes() for g in gone}
                    all_lines = t.split("\n")
                    keys = [line_key(x.encode(), min_chars) for x in all_lines]
                    stay = [x for x, k in zip(all_lines, keys, strict=True) if k is None or xxhash.xxh3_128_digest(k) not in gone]
                    n, t = len(all_lines) - len(stay), "\n".join(stay)
                lines.append(len(all_lines) if all_lines else t.count("\n") + 1)
                kept.append(t)
                dropped.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], ["row", "kept", "n_lines", "n_dropped"])

    schema = T.StructType([T.StructField("row", row.schema["row"].dataType), T.StructField("kept", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return both.mapInArrow(run, schema)


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs' own columns with the text, and n_chars where there is one, as the drops leave them."""
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return drop_repeated_lines(docs).select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def lines_sql(documents: str) -> str:
    """DuckDB SQL: CTEs up to `line_left` (doc_id, n_lines, n_dropped, kept) over the relation `documents`."""
    key = "translate(regexp_replace(ln, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    lines0 as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as ln, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from {documents}),
    lines1 as (select doc_id, i, ln, {key} as k from lines0),
    line_keys as (select k, max(doc_id) as keeper from lines1 where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
    lines2 as (select l.*, s.keeper is not null and s.keeper <> l.doc_id as gone from lines1 l left join line_keys s on l.k = s.k),
    line_left as (select doc_id, count(*)::BIGINT as n_lines, sum(gone::INT)::BIGINT as n_dropped, coalesce(string_agg(ln, chr(10) order by i) filter (not gone), '') as kept from lines2 group by doc_id)"""


QUERIES = {"op4_line_dedup": op4_line_dedup}
SQL = {"op4_line_dedup": f"with {lines_sql('documents')} select doc_id, n_lines, n_dropped, sha256(kept) as kept_sha256 from line_left"}
