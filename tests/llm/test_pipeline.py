"""The pipeline's stages hand on the columns of documents, and their decisions take effect."""

import hashlib
import random
import zlib
from collections import Counter

import corpus_pipeline
from fleetctx.llm import mixing, shared, simhash

from .fixtures import CLASH, awkward, frame
from .test_operators import WS, brute_contamination, brute_rendezvous


def inputs(spark, tmp_path, rows, clash=()):
    frame(spark, rows, clash).write.parquet(f"file://{tmp_path}/documents.parquet")
    bench = spark.createDataFrame([(1, BENCH), (2, None)], "item_id long, text string")
    bench.write.parquet(f"file://{tmp_path}/benchmark.parquet")
    return f"file://{tmp_path}"


rng = random.Random(3)
words = ["stone", "river", "cloud", "green", "walks", "under", "seven", "paper", "light", "house", "music", "train"]
prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
BENCH = prose(30)
DOCS = [(k, prose(150) + ".", "en", "src1", 1) for k in range(60)]


def test_stages(spark, tmp_path):
    copy, dirty = (70, DOCS[3][1], "en", "src1", 1), (71, f"{prose(40)} {BENCH} {prose(40)}", "en", "src1", 1)
    sf = inputs(spark, tmp_path, [*DOCS, copy, dirty, (72, "12345", "en", "src1", 1)])
    docs = shared.documents(spark, sf)
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = shared.materialize(stage(spark, docs, sf), name)
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert name == "sharding" or docs.columns == columns
    everyone = {r[0] for r in DOCS}
    assert seen[0] == everyone | {70, 71}
    assert seen[1] == everyone | {71}
    assert seen[2] == everyone
    assert seen[3] == seen[4] <= everyone
    again = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, docs.collect()))


def test_awkward_and_empty(spark, tmp_path):
    sf = inputs(spark, tmp_path / "a", awkward(), CLASH)
    assert corpus_pipeline.run(spark, sf).count() > 0
    sf = inputs(spark, tmp_path / "b", [])
    assert corpus_pipeline.run(spark, sf).count() == 0


def brute_near_dedup(rows):
    """The least doc_id of each component of all pairs."""
    sets = {r[0]: set(simhash.shingles(r[1], 5).tolist()) for r in rows}
    fps = {r[0]: simhash.fingerprint(r[1], 5) & (2**64 - 1) for r in rows}
    root = {r[0]: r[0] for r in rows}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and ((fps[a] ^ fps[b]).bit_count() <= 4 or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {d: new if x == old else x for d, x in root.items()}
    return [r for r in rows if root[r[0]] == r[0]]


def brute_decontaminate(rows):
    dirty = {c[0] for c in brute_contamination([(r[0], r[1]) for r in rows], [(1, BENCH)]) if c[-1]}
    return [r for r in rows if r[0] not in dirty]


def brute_mix(rows):
    """Two domains of equal weight and one leaf each: half of all tokens for either, in seeded epochs."""
    leaves = {k: [r for r in rows if r[3] == k] for k in ("src1", "src12")}
    tokens = {r[0]: len(WS.findall(r[1])) for r in rows}
    quota, out = int(sum(tokens.values()) / 2 + 0.5), Counter()
    for leaf in leaves.values():
        supply = sum(tokens[r[0]] for r in leaf)
        whole, rest = divmod(min(quota, supply * mixing.MAX_EPOCHS), supply)
        at = 0
        for r in sorted(leaf, key=lambda r: hashlib.md5(f"{mixing.SEED}:{whole}:{r[0]}".encode()).hexdigest()):
            out[r[0]] += whole + (at < rest)
            at += tokens[r[0]]
    return [r for r in rows for _ in range(out[r[0]])]


def test_stages_equal_brute_force(spark, tmp_path):
    """Each stage after the first against loops over all that its predecessor kept."""
    rows = [(k, t, lang, "src12" if k % 3 == 0 else "src1", n) for k, t, lang, _, n in DOCS]
    for k in range(20):
        words_ = rows[k][1].split()
        for at in rng.sample(range(len(words_)), k % 6):
            words_[at] = "changed"
        rows.append((100 + k, " ".join(words_), "en", rows[k][3], 1))
    rows += [(200 + k, f"{prose(30 + 60 * k)} {BENCH} {prose(20)}", "en", "src1", 1) for k in range(8)]
    sf = inputs(spark, tmp_path, rows)
    docs, want = shared.documents(spark, sf), rows
    stages = dict(corpus_pipeline.STAGES)
    docs = shared.materialize(stages["language_id"](spark, docs, sf), "s")
    assert docs.count() == len(rows)
    for name, brute in (("near_dedup", brute_near_dedup), ("decontamination", brute_decontaminate), ("mixing", brute_mix)):
        docs, before, want = shared.materialize(stages[name](spark, docs, sf), "s"), want, brute(want)
        assert sorted(map(tuple, docs.collect())) == sorted(want) and len(want) != len(before), name
    out = stages["sharding"](spark, docs, sf).collect()
    key = lambda r, n: brute_rendezvous(str(r[0]), [1.0] * n)
    assert sorted((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in out) == sorted((r[0], len(r[1].encode()) + 8, zlib.crc32(r[1].encode()), key(r, 24), key(r, 25)) for r in want)
