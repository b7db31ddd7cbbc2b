"""Each operator on awkward rows and on none, against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import covering, fingerprints, licenses, lines, mixing, packing, quality, shingles, simhash, spans, substrings, suffixes, warc
from graphloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def key(i):
    return -(1 << 63) if i is None else i


def test_mixing_quotas(spark, awkward, nothing):
    got = mixing.mix_sources(awkward, block_words=64, shard_words=500).collect()
    assert len(got) == awkward.count()
    size = Counter()
    for i, t in rows_of(awkward):
        size[i] += len(WORD.findall(t))
    by = defaultdict(lambda: [0, 0, 0.0])
    for r in got:
        assert r.size * len(r.draws) <= 3 * r.size and r.target <= 3 * r.source_size + 1e-6
        by[r.source][0] += r.size
        by[r.source][1] += r.size * len(r.draws)
        by[r.source][2] = r.target
        assert len({d.epoch for d in r.draws}) == len(r.draws)
    assert sum(x[2] for x in by.values()) == pytest.approx(sum(x[0] for x in by.values()))
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(awkward, block_words=64, shard_words=500).collect()))
    out = mixing.materialize(awkward, mixing.mix_sources(awkward))
    assert out.columns == awkward.columns
    assert mixing.mix_sources(nothing).count() == 0 and mixing.materialize(nothing, mixing.mix_sources(nothing)).count() == 0


def test_targets_fill_up_to_the_cap(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes, (5, 2, 1), 3).collect()}
    assert got["a"] == 30 and got[None] == 0
    assert got["b"] == pytest.approx((2010 - 30) * 2 / 3) and got["c"] == pytest.approx((2010 - 30) / 3)


def test_hypergeometric_follows_its_law(spark):
    u = "(id + 0.5D) / 20000D"
    got = spark.range(20000).select(F.expr(mixing.hypergeometric("50L", "17L", "20L", u)).alias("x")).groupBy("x").count().collect()
    law = {x: math.comb(17, x) * math.comb(33, 20 - x) / math.comb(50, 20) for x in range(18)}
    for r in got:
        assert abs(r["count"] / 20000 - law[r.x]) < 2e-4
    big = spark.range(2000).select(F.expr(mixing.hypergeometric("1000000L", "300000L", "500000L", "(id + 0.5D) / 2000D")).alias("x")).agg(F.avg("x"), F.stddev("x")).first()
    assert abs(big[0] - 150000) < 5 and abs(big[1] - math.sqrt(500000 * 0.3 * 0.7 * 0.5)) < 3


def test_split_keeps_quotas(spark):
    q = spark.createDataFrame([([1000, 7, 0, 333],)], "q array<bigint>")
    got = [r.q for r in mixing.split(q, 4, 3).collect()]
    assert len(got) == 16 and [sum(c) for c in zip(*got, strict=True)] == [1000, 7, 0, 333]
    assert max(map(sum, got)) - min(map(sum, got)) <= 1


def test_quality_counts(awkward, nothing):
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.counts(awkward).collect()}
    for i, t in rows_of(awkward):
        w = WORD.findall(t)
        win = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        c = Counter(win)
        covered = {k + j for k, x in enumerate(win) if c[x] > 1 for j in range(3)}
        ls = [x for x in t.split("\n") if WORD.search(x)]
        assert (i, len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(ls) - len(set(ls)), len(covered)) in got
    assert quality.judge(nothing).count() == 0 and quality.keep_good(nothing).count() == 0
    kept = quality.keep_good(awkward)
    assert kept.columns == awkward.columns and all(len(WORD.findall(r.text or "")) >= 50 for r in kept.collect())


def test_quality_verdicts_on_labelled_junk(spark):
    docs = spark.createDataFrame([(i, " ".join(f"word{i}x{k}" for k in range(120)), 1) for i in range(60)] + [(i, " ".join(f"w{i}{k}***" for k in range(120)), 0) for i in range(60, 70)], "doc_id long, text string, good int")
    got = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    assert all(got[i] for i in range(60)) and not any(got[i] for i in range(60, 70))


@pytest.mark.parametrize("bits", [lines.MOST_BITS, 64])
def test_lines(awkward, nothing, bits):
    """With one part, and with more lines than a part's filters hold."""
    held = defaultdict(set)
    norm = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    docs = rows_of(awkward)
    for i, t in docs:
        for x in t.split("\n"):
            if len(norm(x)) >= 20:
                held[norm(x)].add(i)
    keeper = {k: max(x for x in v if x is not None) for k, v in held.items() if len(v - {None}) >= 3}
    expected = Counter()
    for i, t in docs:
        kept = [x for x in t.split("\n") if norm(x) not in keeper or keeper[norm(x)] == i]
        expected[i, t.count("\n") + 1, t.count("\n") + 1 - len(kept), "\n".join(kept)] += 1
    got = lines.drop_repeated_lines(awkward, most_bits=bits).select("row.doc_id", "n_lines", "n_dropped", "kept").collect()
    assert Counter(map(tuple, got)) == expected
    assert lines.drop_repeated_lines(nothing).count() == 0
    assert lines.without_repeated_lines(awkward).columns == awkward.columns


def test_lines_are_filtered_at_every_size(spark):
    """However small the filters, only repeats (and a few others by accident) shuffle, and none is lost."""
    rows = [(i, "\n".join([f"this line is only found in text {i} as line {k}" for k in range(40)] + [f"a passage that some texts share, number {i % 50}"])) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for bits in (lines.MOST_BITS, 1 << 15):  # 8200 lines: one part, and four
        found = lines.suspects(docs, 20, bits)
        shared = {xxhash.xxh3_128_digest(f"a passage that some texts share, number {i}".encode()) for i in range(50)}
        got = [np.array([r.hi, r.lo], np.int64).tobytes() for r in found.collect()]
        assert len([d for d in got if d in shared]) == 200
        assert len(got) < 200 + 800  # of 8000 lines that occur once


def test_lines_of_rows_that_share_a_doc_id(spark):
    line = "the very same line in many rows of one id"
    rows = [(None, f"{line}\nown {i}") for i in range(50)] + [(1, line), (2, line + "\nx"), (3, line), (3, "y\n" + line)]
    got = lines.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("row.doc_id", "n_dropped", "kept").collect()
    assert Counter(map(tuple, got)) == Counter([(None, 1, f"own {i}") for i in range(50)] + [(1, 1, ""), (2, 1, "x"), (3, 0, line), (3, 0, "y\n" + line)])


def test_packing(awkward, nothing):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_file())
    expected = Counter()
    for i, t in rows_of(awkward):
        ids = tok.encode(t, add_special_tokens=False).ids + [1]
        for n, a in enumerate(range(0, len(ids), 4096)):
            part = ids[a : a + 4096]
            expected[i, n, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = packing.pack(packing.cut(awkward), per_task=4).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 4096
    assert packing.pack_documents(nothing).count() == 0 and packing.certificate(packing.pack_documents(nothing)) == (0, 0)


def test_sequences_used_are_near_the_bound(spark):
    """Many partitions, repacked: within two in a hundred of what any packing needs."""
    rng = np.random.default_rng(12)
    sizes = np.concatenate([rng.integers(1, 4097, 2000), rng.integers(1, 600, 6000), np.full(500, 1400)])
    pieces = spark.createDataFrame([(i, 0, 0, int(n), i) for i, n in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    used, bound = packing.certificate(packing.pack(pieces, per_task=500))
    assert bound <= used <= 1.02 * bound and bound >= -(-int(sizes.sum()) // 4096)


def test_words_are_encoded_alike_when_tables_are_full():
    rng = np.random.default_rng(3)
    docs = [" ".join(f"word{x}," for x in rng.integers(0, 60, 40)) for _ in range(50)]
    small, large = packing.Encoder(packing.tokenizer_file(), 20), packing.Encoder.of(packing.tokenizer_file())
    for k in range(0, 50, 5):
        assert list(small.encode(docs[k : k + 5])) == list(large.encode(docs[k : k + 5]))
    assert len(small.words) + len(small.old_words) < 200


def test_bounds_and_best_fit():
    rng = np.random.default_rng(1)
    for _ in range(50):
        sizes = rng.integers(1, 101, rng.integers(1, 60))
        bins, offsets, rooms = packing.best_fit(sizes, 100)
        used = np.bincount(bins, weights=sizes)
        assert (used <= 100).all() and (100 - used == rooms).all()
        assert packing.lower_bound(sizes, 100) <= len(rooms) and packing.lower_bound(sizes, 100) >= -(-sizes.sum() // 100)
    assert packing.lower_bound(np.array([60] * 7), 100) == 7


def test_tokens_of_words_are_tokens_of_texts():
    from tokenizers import Tokenizer

    path = packing.tokenizer_file()
    tok = Tokenizer.from_file(path)
    hard = ["Don't STOP, it's 42% of 'we're'…", "ΣΑΣ ΟΔΟΣ été İstanbul ǅ ﬁne", "a b c <|endoftext|>x end<|startoftext|>", "漢字かな交じり 😀😀 \x1c\x00 ß", ""]
    for t, got in zip(hard, packing.Encoder.of(path).encode(hard), strict=True):
        assert got == np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def brute_prints(docs):
    out = []
    for i, t in docs:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        sh = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        out.append((i, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    return out


def test_simhash(awkward, nothing):
    prints = brute_prints(rows_of(awkward))
    got = simhash.groups(simhash.fingerprints(awkward)).collect()
    assert Counter((r.doc_id, r.fp % (1 << 64)) for r in got) == Counter(prints)
    fps = sorted({f for _, f in prints})
    root = {f: f for f in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if bin(a ^ b).count("1") <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    least = {}
    for i, f in prints:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    assert all(r.component_id == least.get(root[r.fp % (1 << 64)]) for r in got)
    assert simhash.groups(simhash.fingerprints(nothing)).count() == 0 and shingles.keep_one(nothing).count() == 0
    assert shingles.keep_one(awkward).columns == awkward.columns


def test_covering_tables_miss_no_pair():
    for radius, over in ((2, covering.FULL), (2, 0xFFF0), (3, 0xFFFF)):
        masks, bits = covering.covering(radius, over), [b for b in range(64) if over >> b & 1]
        assert len(masks) == 2 ** (radius + 1) - 1
        for i in bits:
            for j in bits:
                assert any(not m & (1 << i | 1 << j) for m in masks)


@pytest.mark.parametrize("most", [2, 2048])
def test_links_of_crowded_buckets(spark, most):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base:
        for _ in range(60):
            fps.add(int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 5), replace=False)))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(s, s) for s in signed], "node long, fp long")
    roots = {r.node: r.root for r in components(covering.links(df, most=most)).collect()}
    label = {s: s for s in signed}
    changed = True
    near = [(signed[i], signed[j]) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2]
    while changed:
        changed = False
        for a, b in near:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    assert {s: roots.get(s, s) for s in signed} == label


def test_near_copies_leave_one(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows, n = [], 0
    for g in range(40):
        text = list(rng.choice(vocabulary, 300))
        for c in range(3):
            own = list(text)
            for k in rng.choice(300, c * 2, replace=False):
                own[k] = "changed"
            rows.append((n, " ".join(own), g))
            n += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, g int")
    kept = [r.doc_id for r in shingles.keep_one(docs).collect()]
    assert sorted(kept) == list(range(0, 120, 3))


def brute_bytes(docs, length=100):
    out = Counter()
    order = sorted(docs, key=lambda x: key(x[0]))
    first = {}
    for i, t in order:
        b = t.encode()
        for p in range(len(b) - length + 1):
            first[b[p : p + length]] = min(first.get(b[p : p + length], (key(i), p)), (key(i), p))
    for i, t in order:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < (key(i), p):
                gone[p : p + length] = True
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[i, len(b), int(gone.sum()), runs, bytes(x for x, g in zip(b, gone, strict=True) if not g)] += 1
    return out


def test_suffixes(awkward, nothing):
    got = suffixes.drop_repeated_bytes(awkward).collect()
    assert Counter((r.row.doc_id, r.n_units, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == brute_bytes(rows_of(awkward))
    assert suffixes.drop_repeated_bytes(nothing).count() == 0


def test_suffix_block_orders_all_windows():
    rng = np.random.default_rng(0)
    base = rng.integers(97, 100, 400, dtype=np.uint8)
    data = np.concatenate([rng.integers(97, 100, 37, dtype=np.uint8), base, rng.integers(97, 100, 50, dtype=np.uint8), base[50:350], base[:200], np.full(300, 97, np.uint8)])
    start = np.arange(len(data) - 99)
    found = suffixes.sort_block(data, start, 100)
    expected = np.unique([data[i : i + 100].tobytes() for i in start], return_inverse=True)[1]
    assert len(set(zip(found.tolist(), expected.tolist(), strict=True))) == len(set(expected.tolist())) == len(set(found.tolist()))


@pytest.mark.parametrize(("block", "crowd"), [(150, 1024), (400, 1024), (3000, 1024), (1 << 21, 3)])
@pytest.mark.parametrize("words", [False, True])
def test_crowded_anchors_pass_on_windows(spark, block, crowd, words):
    rng = np.random.default_rng(2)
    letters = lambda n: (" " if words else "").join(chr(x) for x in rng.integers(97, 123, n))
    shared = letters(160)
    join = (lambda *x: " ".join(x)) if words else (lambda *x: "".join(x))
    docs = [(i, join(letters(120), shared, letters(130))) for i in range(12)] + [(20, join(shared, shared, shared))]
    rule = spans.Rule(50, 8, True, False, substrings.solve) if words else spans.Rule(100, 24, False, True, suffixes.solve)
    found = spans.repeats(spans.keyed(spark.createDataFrame(docs, "doc_id long, text string")), rule, block, crowd).collect()
    got = {r.doc: sum(j - i for i, j in spans.covered(np.array(r.ranges), rule.length)) for r in found}
    assert got == {k[0]: k[2] for k in (brute_words(docs) if words else brute_bytes(docs)) if k[2]}


def rows_of_one_id(n):
    """Many rows without a doc_id whose texts repeat themselves and each other, and some rows twice."""
    rng = np.random.default_rng(6)
    passage = " ".join(f"w{x}" for x in rng.integers(0, 900, 60))
    rows = [(None, f"row {i} of many {passage[: 150 + i % 90]} then {i} again {passage[: 150 + i % 90]}" if i % 6 == 0 else f"short {i}") for i in range(n)]
    return [*rows, *rows[:600:7], (1, passage), (2, passage + " more"), (2, "before " + passage)]


def test_many_rows_without_an_id(spark):
    rows = rows_of_one_id(12000)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffixes.drop_repeated_bytes(docs).collect()
    assert Counter((r.row.doc_id, r.n_units, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == brute_bytes(rows)
    got = substrings.drop_repeated_passages(docs).collect()
    assert Counter((r.row.doc_id, r.n_units, r.n_removed, bytes(r.kept)) for r in got) == brute_words(rows)


@pytest.mark.parametrize("words", [False, True])
def test_keys_that_collide_don_t_crash(spark, words):
    rule = spans.Rule(50, 8, True, False, substrings.solve) if words else spans.Rule(100, 24, False, True, suffixes.solve)
    rng = np.random.default_rng(8)
    text = " ".join(f"w{x}" for x in rng.integers(0, 900, 300))
    docs = spark.createDataFrame([(1, "x " + text), (2, text), (2, "short"), (2, text[:400] + " z " + text[300:]), (3, text)], "doc_id long, text string")
    assert spans.repeats(spans.keyed(docs).withColumn("tag", F.lit(5).cast("long")), rule).count() == 2


def brute_words(docs, length=50):
    order = sorted(docs, key=lambda x: key(x[0]))
    first = {}
    for i, t in order:
        w = (t or "").encode().split()
        for p in range(len(w) - length + 1):
            k = tuple(w[p : p + length])
            first[k] = min(first.get(k, key(i)), key(i))
    expected = Counter()
    for i, t in order:
        w = (t or "").encode().split()
        gone = set()
        for p in range(len(w) - length + 1):
            if first[tuple(w[p : p + length])] < key(i):
                gone |= set(range(p, p + length))
        expected[i, len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone)] += 1
    return expected


def test_substrings(awkward, nothing):
    got = substrings.drop_repeated_passages(awkward).collect()
    assert Counter((r.row.doc_id, r.n_units, r.n_removed, bytes(r.kept)) for r in got) == brute_words(rows_of(awkward))
    assert substrings.drop_repeated_passages(nothing).count() == 0
    spans_of = defaultdict(set)
    for r in substrings.long_factors(awkward).collect():
        spans_of[r.doc_id] |= set(range(r.first_word, r.first_word + r.n_words))
    assert {i: len(x) for i, x in spans_of.items()} == {k[0]: k[2] for k in brute_words(rows_of(awkward)) if k[2]}


def test_parse_is_the_greedy_one():
    """Factors of each text against the texts of smaller documents, by trying every place and length."""
    rng = np.random.default_rng(9)
    for _ in range(80):
        sizes = rng.integers(0, 15, rng.integers(1, 7))
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        codes, doc = rng.integers(0, 3, bounds[-1]).astype(np.uint64), rng.integers(0, 4, len(sizes))
        text = [codes[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        grams = [{tuple(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1)} for x in text]
        expected, windows = [], []
        for t, x in enumerate(text):
            has = lambda i, j, t=t, x=x: any(tuple(x[i:j]) in g for g, d in zip(grams, doc, strict=True) if d < doc[t])
            at = 0
            while at < len(x):
                n = max([j for j in range(1, len(x) - at + 1) if has(at, at + j)], default=1)
                expected.append((bounds[t] + at, n))
                at += n
            windows += [bounds[t] + i for i in range(len(x) - 3) if has(i, i + 4)]
        longest = substrings.longest_matches(codes, bounds, doc)
        assert list(zip(*substrings.greedy_factors(longest, bounds), strict=True)) == expected
        assert np.flatnonzero(substrings.repeated_windows(longest, bounds, 4)).tolist() == windows


def test_fingerprints(awkward, nothing):
    order = sorted(rows_of(awkward), key=lambda x: (key(x[0]), x[1]))
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    expected = Counter()
    for n, (i, t) in enumerate(order):
        nxt = order[(n + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        a, b, c = (set(fingerprints.paragraphs(x).tolist()) for x in (t, edited, nxt))
        expected[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), jaccard(a, b), jaccard(a, c)] += 1
    got = fingerprints.compare(awkward).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got) == expected
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.fingerprint)
    assert by[11] == by[12] and by[3] == by[4] and by[1] != by[2]
    assert fingerprints.compare(nothing).count() == 0
    assert fingerprints.compare(awkward.where("doc_id = 5")).first().near_next == 1.0


def test_sketch_round_trip():
    rng = np.random.default_rng(4)
    for shared, a, b in ((100, 5, 3), (0, 40, 0), (500, 200, 190), (0, 0, 0)):
        d = np.unique(rng.integers(0, 1 << 63, shared + a + b, dtype=np.uint64))
        x, y = d[: shared + a], np.concatenate((d[:shared], d[shared + a :]))
        cells = 8
        while (out := fingerprints.Sketch.of(x, cells).peel(fingerprints.Sketch.of(y, cells))) is None:
            cells *= 2
        assert set(out[0]) == set(x) - set(y) and set(out[1]) == set(y) - set(x)
        assert fingerprints.Sketch.of(x, 64).fold(16).text() == fingerprints.Sketch.of(x, 16).text()


def test_licenses(spark, awkward, nothing):
    header = dict(licenses.TEMPLATES)["Apache-2.0-header"]
    docs = spark.createDataFrame([(1, "some words before. " + header + " and after"), (2, header.replace("Version", "Edition")), (3, "Released under the\nMIT  License!"), (4, "licensed under nothing at all"), (5, None), (6, "")], "doc_id long, text string")
    got = {(r.doc_id, r.license): round(r.containment, 3) for r in licenses.scan(docs).collect()}
    assert got[1, "Apache-2.0-header"] == 1.0 and got[3, "MIT"] == 1.0 and not {i for i, _ in got} & {4, 5, 6}
    assert got.get((2, "Apache-2.0-header"), 1.0) >= 0.8
    assert licenses.scan(nothing).count() == 0
    assert licenses.scan(awkward).count() == 0


def test_licenses_against_brute_force(spark):
    """Templates in whole, with words changed and cut short, in long texts; from a table, in one pass and in many."""
    rng = np.random.default_rng(17)
    words = lambda t: [x for x in re.split("[^a-z0-9]+", t.lower()) if x]
    filler = lambda n: " ".join(f"f{x}" for x in rng.integers(0, 9999, n))
    rows = []
    for i, (_, t) in enumerate(licenses.TEMPLATES):
        w = t.split()
        for j, changed in enumerate((0, 1, max(1, len(w) // 12), max(1, len(w) // 5))):
            own = list(w)
            for x in rng.choice(len(w), min(changed, len(w)), replace=False):
                own[x] = "changed"
            rows.append((10 * i + j, f"{filler(int(rng.integers(0, 90)))} {' '.join(own)} {filler(int(rng.integers(0, 90)))}"))
        rows.append((10 * i + 4, " ".join(w[: len(w) // 2])))
    rows += [(9000, "// SPDX-License-Identifier: MIT\nx\n# spdx-license-identifier:GPL-2.0-or-later\nSPDX-License-Identifier: MIT"), (9001, "SPDX-License-Identifier: "), (9000, "again SPDX-License-Identifier: MIT")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = {}
    for i, t in rows:
        w = words(t)
        for name, template in licenses.TEMPLATES:
            v = words(template)
            known = {tuple(v[x : x + 5]) for x in range(len(v) - 4)}
            width = 1 << (len(known) - 1).bit_length()
            here = [tuple(w[x : x + 5]) for x in range(len(w) - 4)]
            share = max((len(known & set(here[max(0, s) : s + 2 * width])) / len(known) for s in range(-width, len(here), width)), default=0)
            if share >= 0.8:
                expected[i, name] = round(share, 9)
    expected |= {(9000, "MIT"): 1.0, (9000, "GPL-2.0-or-later"): 1.0}
    listed = spark.createDataFrame(list(licenses.TEMPLATES), "license string, text string")
    for most in (licenses.MOST_LITERALS, 400):
        got = {(r.doc_id, r.license): r for r in licenses.scan(docs, listed, most=most).collect()}
        assert {k: round(r.containment, 9) for k, r in got.items()} == expected
        assert got[9000, "MIT"].windows == 3 and got[9000, "MIT"].first_word is None


def test_warc(spark, nothing, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.example/x", "<html lang='en'><head><title>T &amp; x</title><script>no()</script></head><body><p>One &lt;two&gt;</p><div>three<br>four <b>bold</b></div><!-- gone --><a href='/l'>link</a></body></html>"), (2, None, None), (2, None, None), (3, "http://b.example", "no tags é"), (4, "u", "<p>open <script>never closed")], "page_id long, url string, html string")
    made = warc.responses(pages)
    every = made.union(warc.derive(made)).cache()
    got = {(r.page_id, r.warc_type): r for r in every.collect()}
    assert every.count() == 15
    assert got[1, "conversion"].block.decode() == "One <two>\nthree\nfour bold\nlink" and got[3, "conversion"].block.decode() == "no tags é" and got[4, "conversion"].block.decode() == "open"
    for i in (1, 3, 4):
        r = got[i, "response"]
        for kind in ("metadata", "conversion"):
            assert got[i, kind].refers_to == r.record_id and got[i, kind].target_uri == r.target_uri and got[i, kind].payload_digest == r.payload_digest
        assert r.block_digest == warc.digest(bytes(r.block)) and f"source-payload-digest: {r.payload_digest}" in got[i, "metadata"].block.decode()
    for gz in (False, True):
        warc.save(every, str(tmp_path / f"w{gz}"), gz)
        back = warc.load(spark, str(tmp_path / f"w{gz}"))
        assert back.exceptAll(every).count() == 0 and every.exceptAll(back).count() == 0
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0
