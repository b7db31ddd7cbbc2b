"""Each stage of the pipeline against plain Python or SQL on what its predecessor kept, and the whole on odd tables."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import packing, quality

from .test_near_duplicates import exact_groups

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark):
    """Clean texts of four sources, near copies, shared lines, and junk of two kinds."""
    rng = np.random.default_rng(21)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 9)))
    text = lambda n: "\n".join(" ".join(word() for _ in range(12)).capitalize() + "." for _ in range(n))
    shared = "a line of some length that many of the texts hold."
    rows = []
    for i in range(160):
        t = text(int(rng.integers(8, 20)))
        if i % 5 == 0:
            t = shared + "\n" + t
        rows.append((i, t, "en", f"s{i % 4}", len(t)))
        if i % 8 == 0:
            near = t.split(" ")
            near[len(near) // 2] = "changed"
            rows.append((1000 + i, " ".join(near), "en", "s0", 1))
    rows += [(2000 + i, text(10).replace(" ", "$$$ ### "), "en", "s1", 1) for i in range(6)] + [(3000, "too short", "en", "s1", 1), (3001, None, None, None, None), (None, text(9), "en", None, 1), (7, rows[7][1], "en", "s3", 1)]
    return spark.createDataFrame(rows, COLUMNS).cache()


def kept(df):
    return Counter((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect())


def brute_lines(rows):
    norm = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    held = defaultdict(set)
    for (i, t), _ in rows.items():
        for x in t.split("\n"):
            if len(norm(x)) >= 20:
                held[norm(x)].add(i)
    keeper = {k: max(x for x in v if x is not None) for k, v in held.items() if len(v - {None}) >= 3}
    out = Counter()
    for (i, t), n in rows.items():
        out[i, "\n".join(x for x in t.split("\n") if norm(x) not in keeper or keeper[norm(x)] == i)] += n
    return out


def brute_near(rows):
    """One row of each group: the smallest doc_id's, null last."""
    order = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0))
    groups = exact_groups(list(enumerate(t for _, t in order)))
    return Counter(order[k] for k, g in groups.items() if k == g)


def test_stages(spark, corpus):
    duckdb = pytest.importorskip("duckdb")
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality"](spark, corpus, "").cache()
    con = duckdb.connect()
    con.register("documents", corpus.withColumn("row", F.monotonically_increasing_id()).select("row", F.col("row").alias("doc_id"), "text").toPandas())
    verdict = {r[0] for r in con.execute(f"with recursive {quality.quality_sql('documents')} select doc_id from judged where kept").fetchall()}
    want = Counter((r.doc_id, r.text or "") for r in corpus.withColumn("row", F.monotonically_increasing_id()).collect() if r.row in verdict)
    assert kept(good) == want and good.columns == corpus.columns
    assert not any(i is not None and 2000 <= i for i, _ in want) and sum(want.values()) == 160 + 20 + 1 + 1  # all clean rows and no other

    lines = stage["lines"](spark, good, "").cache()
    assert kept(lines) == brute_lines(kept(good)) and all(r.n_chars == len(r.text) for r in lines.collect())
    assert sum("a line of some length" in t for _, t in kept(lines)) == 1

    near = stage["near_duplicates"](spark, lines, "").cache()
    assert kept(near) == brute_near(kept(lines)) and near.count() == 161

    mixed = stage["mixing"](spark, near, "").cache()
    words = {(r.doc_id, r.text): len(r.text.split()) for r in near.collect()}
    source = {(r.doc_id, r.text): r.source for r in near.collect()}
    taken, size = Counter(), Counter()
    for x, n in kept(mixed).items():
        assert 1 <= n <= 3 and x in words
        taken[source[x]] += n * words[x]
    for x, n in words.items():
        size[source[x]] += n
    weights = dict(zip(sorted(size, key=lambda s: (s is None, s)), (5, 2, 1, 5, 2), strict=False))
    goal, open_, left = {}, set(size), sum(size.values())
    while open_:  # shares by weight, none above three times its source
        over = {s for s in open_ if left * weights[s] / sum(weights[x] for x in open_) > 3 * size[s]}
        goal |= {s: 3 * size[s] for s in over} if over else {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        left -= sum(goal[s] for s in over)
        open_ = open_ - over if over else set()
    for s, g in goal.items():
        assert abs(taken[s] - g) <= max(words.values()), (s, taken[s], g)

    packed = stage["packing"](spark, mixed, "").cache()
    encoder, want = packing.Encoder.of(packing.tokenizer_file()), Counter()
    for (i, t), n in kept(mixed).items():
        (ids,) = encoder.encode([t])
        ids += np.array([1], "<u4").tobytes()
        for k, at in enumerate(range(0, len(ids), 4 * 4096)):
            want[i, k, at // 4, len(ids[at : at + 4 * 4096]) // 4, zlib.crc32(ids[at : at + 4 * 4096])] += n
    rows = packed.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    room = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == room[r.sequence_id]
        room[r.sequence_id] += r.length
    used, bound = packing.certificate(packed)
    assert max(room.values()) <= 4096 and len(room) == used <= bound + 1


def test_odd_tables(spark, awkward, corpus):
    docs = awkward.select("doc_id", "text", "lang", "source", "n_chars")
    for given in (docs, docs.limit(0), awkward):
        now = given
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, "")
            if name != "packing":
                assert out.columns == given.columns
                now = out
            out.count()


def test_run_reads_what_it_wrote(spark, corpus, tmp_path):
    corpus.write.parquet(str(tmp_path / "documents.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and found.count() > 100
