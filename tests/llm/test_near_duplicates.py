"""The pipeline's near-duplicate stage against exact Jaccard components of five-word shingles."""

import uuid

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from graphloom.llm import shingles


def shingle_set(text):
    ws = text.lower().split()
    k = min(5, len(ws))
    return frozenset(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)) if ws else frozenset()


def exact_groups(rows):
    """doc_id -> the smallest doc_id of its component over all pairs at 4/5 or more, by comparing every pair."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    label = {i: i for i, _ in sets}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            shared = len(a & b)
            if a == b or 5 * shared >= 4 * (len(a) + len(b) - shared) and shared:
                p, q = sorted((top(i), top(j)))
                label[q] = p
    return {i: top(i) for i, _ in sets}


def changed(rng, words, n):
    own = list(words)
    for k in rng.choice(len(own), n, replace=False):
        own[k] = f"c{rng.integers(1 << 40)}"
    return own


def graded(rng, families=60, words=200):
    """Pairs from about 0.95 down to 0.55 similarity, and chains whose ends are far apart."""
    out = []
    for f in range(families):
        base = [f"v{x}" for x in rng.integers(0, 5000, words)]
        out += [" ".join(base), " ".join(changed(rng, base, 1 + f % 15))]
    for _ in range(4):
        link = [f"v{x}" for x in rng.integers(0, 5000, words)]
        for _ in range(6):
            out.append(" ".join(link))
            link = changed(rng, link, 3)
    return list(enumerate(out))


def family(rng, n=150, words=120):
    """One large family that shares most of its text, most pairs below 0.8 and some above."""
    base, out = [f"v{x}" for x in rng.integers(0, 5000, words)], []
    for _ in range(n // 2):
        own = changed(rng, base, int(rng.integers(2, 8)))
        out += [" ".join(own), " ".join(changed(rng, own, int(rng.integers(1, 5))))]
    return list(enumerate(out))


def grouped(spark, rows, **knobs):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r.component_id for r in shingles.near_groups(docs, **knobs).collect()}


def test_only_texts_at_four_fifths_are_linked(spark):
    rows = graded(np.random.default_rng(11))
    expected = exact_groups(rows)
    got = grouped(spark, rows)
    assert {i: c for i, c in got.items() if c != i and expected[i] == i} == {}  # dropped without a link
    assert 0 < len(set(expected.values())) < len(rows)


@pytest.mark.parametrize("knobs", [{}, {"small": 2, "block": 16}])
def test_crowded_buckets_lose_no_pair(spark, knobs):
    rows = family(np.random.default_rng(12))
    expected = exact_groups(rows)
    assert grouped(spark, rows, **knobs) == expected
    assert 10 < len(set(expected.values())) < len(rows) - 10


def test_every_pair_at_four_fifths_is_found(spark, awkward):
    rng = np.random.default_rng(13)
    rows = graded(rng)
    for f in range(150):  # 200 words, four or five changed: just above and below 0.8
        base = [f"v{x}" for x in rng.integers(0, 5000, 200)]
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(changed(rng, base, 4 + f % 2)))]
    rows += [(len(rows), ""), (len(rows) + 1, " \t\n"), (len(rows) + 2, "one two"), (len(rows) + 3, "ONE\ttwo"), (len(rows) + 4, "one")]
    assert grouped(spark, rows) == exact_groups(rows)
    texts = [(r.doc_id, r.text or "") for r in awkward.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text").collect()]
    assert grouped(spark, texts) == exact_groups(texts)


def test_a_pair_leaves_about_one_of_its_buckets(spark, monkeypatch, tmp_path):
    across, folder = shingles._across, str(tmp_path)

    def noted(rows):
        out = across(rows)
        pq.write_table(out.select(["a", "b"]), f"{folder}/{uuid.uuid4().hex}.parquet")
        return out

    monkeypatch.setattr(shingles, "_across", noted)
    rows = family(np.random.default_rng(12))
    assert grouped(spark, rows, small=2, block=16) == exact_groups(rows)
    sent = [p for f in tmp_path.glob("*.parquet") for p in map(tuple, pq.read_table(f).to_pandas().to_numpy())]
    assert 0 < len(sent) <= 1.5 * len(set(sent))


def test_whole_rows_shuffle_once(spark):
    docs = spark.createDataFrame(graded(np.random.default_rng(15), families=10), "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = shingles.keep_one(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 2  # of the rows, and of the keys that are kept


@pytest.mark.parametrize("bits", [8, 1 << 15, 1 << 18])
def test_the_filter_of_texts_loses_no_key(spark, bits):
    rows = spark.range(4000).select("id", F.xxhash64("id").alias("key"))
    keys = rows.where("id % 10 = 0")
    marks = spark.sparkContext.broadcast(shingles._marks(keys.select("key"), bits))
    got = {r.id for r in shingles._marked(rows, marks).collect()}
    assert set(range(0, 4000, 10)) <= got
    assert bits == 8 or len(got) < 600
