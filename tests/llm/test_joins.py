"""Joins whose sides multiply their rows are never broadcast, however small Spark takes the files under them to be."""

import random
from itertools import combinations

from fleetctx.llm import shared, simhash

from .fixtures import frame


def test_exploded_fingerprints_are_not_broadcast(spark):
    """Files of a few MB hold fingerprints whose questions are GB; the driver of 0.6 GB of documents had no room for them."""
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(60)}
    fps = sorted(simhash._signed(x) for x in fps | {x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for x in fps})
    rows = shared.materialize(spark.createDataFrame([(x, x) for x in fps], "fp long, group long"), "fps")
    unsigned = {x: x & (2**64 - 1) for x in fps}
    near = lambda tau: {p for p in combinations(fps, 2) if (unsigned[p[0]] ^ unsigned[p[1]]).bit_count() <= tau}
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) > 0
    for found, want in ((simhash.links(rows), near(4)), (simhash.one_bit_links(rows), near(1))):
        assert {tuple(sorted((r.u, r.v))) for r in found.collect()} == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_near_dedup_stage_merges_what_it_exploded(spark, monkeypatch):
    """The pipeline's stage writes its links and pairs from merged joins."""
    rng, plans, write = random.Random(6), {}, shared.materialize

    def noted(df, label):
        plans.setdefault(label, []).append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(simhash, "materialize", noted)
    monkeypatch.setattr(shared, "materialize", noted)
    rows = []
    for k in range(8):
        words = [f"w{rng.randrange(500)}" for _ in range(80)]
        rows += [(10 * k, " ".join(words), "en", "s", 1), (10 * k + 1, " ".join([*words[:-2], "other", "end"]), "en", "s", 1)]
    kept = simhash.keep_one(frame(spark, rows), width=5, similarity=0.8)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 80, 10))
    assert plans["cc-edges"][1].count("SortMergeJoin") >= 2  # of the links at 4 bits
    assert "SortMergeJoin" in plans["simhash-pairs-0"][0]
    assert "SortMergeJoin" in plans["simhash-pairs-1"][0] and "Broadcast" not in plans["simhash-pairs-1"][0]


def test_near_dedup_stage_broadcasts_nothing(spark, monkeypatch):
    """At Spark's own threshold no join of the stage, its components and its result included, builds a table in the driver."""
    rng, plans, write = random.Random(7), [], shared.materialize

    def noted(df, label):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, label)

    monkeypatch.setattr(simhash, "materialize", noted)
    monkeypatch.setattr(shared, "materialize", noted)
    rows = [(900, None, "en", "s", 0), (901, "", "en", "s", 0)]
    for k in range(8):
        words = [f"w{rng.randrange(500)}" for _ in range(80)]
        rows += [(10 * k, " ".join(words), "en", "s", 1), (10 * k + 1, " ".join([*words[:-2], "other", "end"]), "en", "s", 1), (10 * k + 2, " ".join(words), "en", "s", 1)]
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) >= 10 << 20
    kept = simhash.keep_one(frame(spark, rows), width=5, similarity=0.8)
    assert sorted(r.doc_id for r in kept.collect()) == [*range(0, 80, 10), 900]
    plans.append(("result", kept._jdf.queryExecution().executedPlan().toString()))
    assert {"cc-edges", "cc-1", "simhash-pairs-0", "simhash-links-0", "simhash-groups", "simhash-named", "result"} <= {k for k, _ in plans}
    assert [k for k, plan in plans if "Broadcast" in plan] == []
