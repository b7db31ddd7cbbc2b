"""Best-fit packing of tokenised documents, with certified bin counts and repacking.

Pieces are dealt to partitions of about `per_task` pieces by a hash and packed there by
best-fit decreasing. Dual feasible functions bound each partition's bin count from
below. A partition above its bound hands on the pieces of all its bins with room; one
at its bound hands on its emptiest bin only. Those pieces meet in partitions a sixteenth
in number and are packed again, until there is one partition or the number no longer
falls. Only (doc_id, piece, start, length, crc) rows shuffle, never tokens.

Tokens of a word don't depend on its neighbours (the tokenizer drops white space), so a worker
encodes a word once and keeps it in a bounded table. A full table becomes the old one, from which
words that occur again are taken over: common words stay, rare ones go.

Defined results: a null or empty text is the closing id alone; repeated rows are packed
one by one; a null doc_id is kept; an empty table gives no rows; other columns aren't
looked at; a text of any length is cut only into full sequences and a rest.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, stored, table, texts

LENGTH, CLOSE, PER_TASK = 4096, 1, 32768
#: Words whose ids a worker keeps, in each of two generations, with half as many parts of words: some 140 bytes each, so 340 MB a worker at most.
KEPT = 800_000
#: Chunks of these characters alone are in composed form, and lower-casing keeps their number of letters.
_PLAIN = regex.compile("[!-~¡-įı-ſ]+")


def tokenizer_file(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return path


def _field(path: str, name: str):
    """A field of the tokenizer's file, without its vocabulary: that has a hundred thousand entries."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    at = text.index(f'"{name}"')
    at = text.index(":", at) + 1
    while text[at].isspace():
        at += 1
    return json.JSONDecoder().raw_decode(text, at)[0]


class Encoder:
    """Texts to packed 32-bit ids (little-endian), word by word."""

    _made: dict[tuple, Encoder] = {}

    def __init__(self, path: str, kept: int = KEPT):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.kept, self.whole = kept, Tokenizer.from_file(path)
        self.part = Tokenizer(self.whole.model)
        self.part.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        pattern = _field(path, "pre_tokenizer")["pretokenizers"][0]["pattern"]["Regex"]
        self.split, self.runs = regex.compile(pattern), pattern.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")  # runs: letters alone are one part
        self.special = [x["content"] for x in _field(path, "added_tokens")]
        self.mark = None if not self.special else self.special[0][0] if len({x[0] for x in self.special}) == 1 else ""  # what every special token begins with
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.old_words: dict[bytes, bytes] = {}
        self.old_parts: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str, kept: int = KEPT) -> Encoder:
        """The worker's encoder for a file and size; one of another size goes."""
        if (path, kept) not in cls._made:
            cls._made.clear()
            cls._made[path, kept] = cls(path, kept)
        return cls._made[path, kept]

    def _learn(self, new: list[bytes]) -> None:
        chars = b"\n".join(new).decode().split("\n") if new else []
        special, mark, runs, findall = self.special, self.mark, self.runs, self.split.findall
        whole = "".join(chars)
        clean = _PLAIN.fullmatch(whole) is not None and not (mark is not None and mark in whole)
        plain, odd = [], []
        for w, c in zip(new, chars, strict=True):
            if clean or _PLAIN.fullmatch(c) and not (mark is not None and mark in c and any(x in c for x in special)):
                c = c.lower()
                if runs and c.isalpha():
                    plain.append((w, (c,)))
                elif runs and c[-1] in ".,;:!?" and c[:-1].isalpha():
                    plain.append((w, (c[:-1], c[-1])))
                else:
                    plain.append((w, findall(c)))
            else:
                odd.append((w, c))
        parts = self.parts
        fresh = []
        for p in {p for _, ps in plain for p in ps if p not in parts}:
            if p in self.old_parts:
                parts[p] = self.old_parts[p]
            else:
                fresh.append(p)
        for p, e in zip(fresh, self.part.encode_batch_fast(fresh, add_special_tokens=False), strict=True):
            parts[p] = array("I", e.ids).tobytes()
        for w, ps in plain:
            self.words[w] = parts[ps[0]] if len(ps) == 1 else b"".join([parts[p] for p in ps])
        for (w, _), e in zip(odd, self.whole.encode_batch([c for _, c in odd], add_special_tokens=False), strict=True):
            self.words[w] = array("I", e.ids).tobytes()

    def encode(self, found: list[str]) -> Iterator[bytes]:
        """The ids of each text. New words of about 2 MB of text are learned together."""
        at = 0
        while at < len(found):
            split, size = [], 0
            while at < len(found) and (not split or size < 1 << 21):
                split.append(found[at].encode().split())
                size += len(found[at])
                at += 1
            if len(self.words) > self.kept:
                self.old_words, self.words = self.words, {}
            if len(self.parts) > self.kept // 2:
                self.old_parts, self.parts = self.parts, {}
            known, old = self.words, self.old_words
            missing = set().union(*split).difference(known)
            again = missing.intersection(old)
            known.update(zip(again, map(old.__getitem__, again), strict=True))
            self._learn(list(missing - again))
            for ws in split:
                yield b"".join(map(known.__getitem__, ws))


def cut(docs: DataFrame, path: str | None = None, length: int = LENGTH, kept: int = KEPT) -> DataFrame:
    """docs with doc_id, text -> a row for each piece: doc_id, piece, start, length, ids_crc32."""
    path = tokenizer_file(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, close = Encoder.of(path, kept), array("I", [CLOSE]).tobytes()
        for whole in batches:
            for i, j in pieces(whole, 1):
                b = whole.slice(i, j - i)
                row, piece, start, size, crc = [], [], [], [], []
                for k, ids in enumerate(encoder.encode(texts(b.column(1)))):
                    ids += close
                    for n, at in enumerate(range(0, len(ids), 4 * length)):
                        part = ids[at : at + 4 * length]
                        row.append(k)
                        piece.append(n)
                        start.append(at // 4)
                        size.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(sizes: np.ndarray, length: int) -> int:
    """The least bins that dual feasible functions allow: above length - x a piece fills a bin, below x it counts nothing."""
    return _bound(np.bincount(sizes, minlength=length + 1), length)


def _bound(count: np.ndarray, length: int) -> int:
    """count: how many pieces there are of each size."""
    mass = np.concatenate(([0], np.cumsum(count * np.arange(length + 1))))
    number = np.concatenate(([0], np.cumsum(count)))
    x = np.arange(length // 2 + 1)
    middle = mass[length - x + 1] - mass[x]
    return int(np.max(-(-middle // length) + number[length + 1] - number[length - x + 1]))


def best_fit(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each piece's bin and offset, and the room left in each bin."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(length + 1)]
    open_rooms, used = 0, 0  # a bit for each room that some bin has
    for i, s in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = open_rooms >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            to = by_room[room].pop()
            if not by_room[room]:
                open_rooms ^= 1 << room
        else:
            room, to, used = length, used, used + 1
        bins[i], offsets[i] = to, length - room
        if room > s:
            by_room[room - s].append(to)
            open_rooms |= 1 << (room - s)
    rooms = np.zeros(used, np.int64)
    for room, held in enumerate(by_room):
        rooms[held] = room
    return bins, offsets, rooms


def _packer(level: int, last: bool, length: int):
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(n, "ascending") for n in names])
        sizes = rows["length"].to_numpy()
        bins, offsets, rooms = best_fit(sizes, length)
        loose = np.zeros(len(rooms), bool)
        if not last:
            loose = rooms > 0 if len(rooms) > lower_bound(sizes, length) else loose
            loose[np.argmax(rooms)] |= rooms.max() > 0
        number = (level << 56) + (rows["bucket"].to_numpy().astype(np.int64) << 32) + bins
        return rows.select(names).append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offsets)).append_column("loose", pa.array(loose[bins]))

    return run


def pack(rows: DataFrame, length: int = LENGTH, per_task: int = PER_TASK) -> DataFrame:
    """rows (doc_id, piece, start, length, ids_crc32) -> the same with sequence_id and offset."""
    pool, done, level = stored(rows), None, 0
    parts = max(1, -(-pool.count() // per_task))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    while True:
        dealt = pool.select(*names).withColumn("bucket", F.pmod(F.xxhash64(F.lit(level), "doc_id", "piece"), F.lit(parts)).cast("int"))
        schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, loose boolean"
        packed = stored(dealt.groupBy("bucket").applyInArrow(_packer(level, parts == 1, length), schema))
        tight = packed.where("not loose").drop("loose")
        done = tight if done is None else done.union(tight)
        if parts == 1:
            return done
        pool, level = packed.where("loose"), level + 1
        fewer = max(-(-parts // 16), -(-pool.count() // per_task))
        if fewer >= parts:
            return done.union(pool.drop("loose"))
        parts = fewer


def certificate(packed: DataFrame, length: int = LENGTH) -> tuple[int, int]:
    """(sequences used, the fewest that any packing of the same pieces can use, by dual feasible functions over all of them)."""
    count = np.zeros(length + 1, np.int64)
    for size, n in packed.groupBy("length").agg(F.count(F.lit(1))).collect():  # a row for each length
        count[size] = n
    return packed.select("sequence_id").distinct().count(), _bound(count, length)


def sequences(docs: DataFrame, packed: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (at most `length`). doc_id is a key of docs here."""
    path = tokenizer_file(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, close = Encoder.of(path), array("I", [CLOSE]).tobytes()
        for whole in batches:
            for i, j in pieces(whole, 1):
                b = whole.slice(i, j - i)
                row, piece, ids = [], [], []
                for k, all_ids in enumerate(encoder.encode(texts(b.column(1)))):
                    all_ids += close
                    for n, at in enumerate(range(0, len(all_ids), 4 * length)):
                        row.append(k)
                        piece.append(n)
                        ids.append(np.frombuffer(all_ids[at : at + 4 * length], np.uint32).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(ids, pa.list_(pa.int32()))], ["_id", "_piece", "ids"])

    parts = docs.select("doc_id", "text").mapInArrow(run, "_id long, _piece int, ids array<int>")
    joined = packed.join(parts, packed.doc_id.eqNullSafe(F.col("_id")) & (packed.piece == F.col("_piece")))
    return joined.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, kept: int = KEPT) -> DataFrame:
    """kept: the size of a worker's word table; a smaller one takes less memory and more time, and gives the same."""
    return pack(cut(docs, kept=kept))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op2_best_fit_packing": op2_best_fit_packing}
SQL: dict[str, str] = {}
