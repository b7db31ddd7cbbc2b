"""Weak supervision on simulated votes: rates recovered, misfires overruled, rare junk rejected; rows of a stage against plain Python."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def simulate(spark, rng, n, junk, hit, misfire, abstain=0.1):
    """One family's patterns and truth: hit and misfire are each rule's chances of a bad vote with and without the defect."""
    bad = rng.random(n) < junk
    votes = np.zeros((n, 3), int)
    for j in range(3):
        p = np.where(bad, hit[j], misfire[j])
        u = rng.random(n)
        votes[:, j] = np.where(u < p, 0, np.where(u < p + (1 - p) * abstain, 1, 2))
    return spark.createDataFrame([(int(c), bool(b)) for c, b in zip(votes @ [1, 3, 9], bad, strict=True)], "pattern int, bad boolean").cache()


def test_rates_are_recovered(spark):
    hit, misfire = (0.9, 0.7, 0.8), (0.02, 0.1, 0.05)
    docs = simulate(spark, np.random.default_rng(1), 20000, 0.1, hit, misfire)
    seen = docs.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    got = {r.rule: r for r in quality.accuracies(quality.fit(seen, 1, 200)).collect()}
    for j in range(3):
        assert abs(got[j].hit - hit[j]) < 0.05 and abs(got[j].misfire - misfire[j]) < 0.05
        assert abs(got[j].defect_share - 0.1) < 0.02


@pytest.mark.parametrize("junk", [0.0, 0.005, 0.02, 0.05, 0.2])
def test_agreement_decides_at_any_share_of_junk(spark, junk):
    docs = simulate(spark, np.random.default_rng(2), 20000, junk, (0.95, 0.9, 0.6), (0.1, 0.005, 0.01))
    p = {r.pattern: r.p_good for r in quality.posterior(docs.select("pattern"), 1).collect()}
    assert p[0 + 6 + 18] >= 0.5  # the rule that misfires on a tenth of the good documents is overruled by two good votes
    truth = docs.groupBy("pattern", "bad").count().collect()
    kept_good = sum(r["count"] for r in truth if not r.bad and p[r.pattern] >= 0.5) / sum(r["count"] for r in truth if not r.bad)
    assert kept_good > 0.99
    if junk:
        assert sum(r["count"] for r in truth if r.bad and p[r.pattern] < 0.5) / sum(r["count"] for r in truth if r.bad) > 0.8


def test_one_odd_count_is_overruled_in_real_texts(spark):
    """A clean text with a table's worth of symbols: one rule votes bad, the family's others don't."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 9)))
    text = lambda n: ". ".join(" ".join(word() for _ in range(12)).capitalize() for _ in range(n)) + "."
    rows = [(i, text(12)) for i in range(300)]
    rows += [(1000 + i, text(20).replace(". ", ". <b> & <i> & ", 8)) for i in range(5)]
    rows += [(2000 + i, re.sub(" ", "$$$ ###", text(12))) for i in range(3)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[1000 + i].n_symbols * 10 > got[1000 + i].n_words for i in range(5))
    assert all(got[i].kept for i in [*range(300), *range(1000, 1005)]) and not any(got[i].kept for i in range(2000, 2003))


def test_stage_keeps_rows_by_their_own_text(spark, awkward, nothing):
    kept = quality.keep_good(awkward)
    judged = Counter((r.doc_id, r.n_words) for r in quality.judge(awkward).collect() if r.kept)
    assert kept.columns == awkward.columns
    assert Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in kept.collect()) == judged
    same = spark.createDataFrame([(None, "word " * 10), (None, None), (7, " ".join(f"each{i} one differs" for i in range(80))), (7, "short")], "doc_id long, text string")
    assert [r.doc_id for r in quality.keep_good(same).collect()] == [7]
    assert quality.keep_good(nothing).count() == 0
