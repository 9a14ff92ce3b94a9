"""Every operator against brute force on awkward tables, empty ones, and ones with clashing columns."""

import hashlib
import math
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from fleetctx.llm import decontam, langid, linededup, mixing, pii, quality, shared, sharding, simhash, substring, suffix, tokens

from .fixtures import CLASH, awkward, frame, tuples

WS = re.compile(r"[^ \t\n\r\x0b\x0c]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
sha = lambda b: hashlib.sha256(b).hexdigest()


def components(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(n)]


# 1. personal data


def brute_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return out


@pytest.mark.parametrize("alphabet", ["a.@-1+ b%", "0123456789 -.", "12.+() -é"])
def test_pii_base_spans_equal_plain_patterns(alphabet):
    rng = random.Random(2)
    for _ in range(4000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert [(pii.KINDS[k], a, z) for k, a, z in pii.base_spans(t)] == brute_spans(t)


def test_pii_luhn():
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487")


def test_pii_linear_on_long_runs():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "+1" + "(" * 300_000, "0" * 5000 + ".1.1.1"):
        pii.base_spans(t), pii.mentions_of(t)
    assert len(pii.mentions_of("1234567 x 12:3 " * 30_000)) == 30_001


def brute_bootstrap(found, least_conf=0.8, least_values=5, class_share=0.01):
    """Spans by document of the graph's rounds, over the mentions of each document, in plain loops."""
    kind_of, klass = {}, {}
    for ms in found.values():
        for m in ms:
            for p in m["patterns"]:
                key = (p, m["value"], m["class"])
                kind_of[key] = max(kind_of.get(key, -1), m["kind"])
            klass[m["value"]] = m["class"]
    values = defaultdict(set)
    for p, v, _ in kind_of:
        values[p].add(v)
    seeds = {(k, v, c) for (p, v, c), k in kind_of.items() if k >= 0}
    shown = Counter((k, c) for k, _, c in seeds)
    classes = {(k, c) for (k, c), n in shown.items() if n >= class_share * sum(m for (j, _), m in shown.items() if j == k)}
    values = {p: vs for p, vs in values.items() if len(vs) >= least_values}
    edges = {key: k for key, k in kind_of.items() if key[0] in values}
    sure = {(k, v): 10**6 for (p, v, c), k in edges.items() if k >= 0}
    conf = sure
    before = None
    while True:
        scores = {}
        for p, vs in values.items():
            for kind in range(4):
                held = [conf[kind, v] for v in vs if (kind, v) in conf]
                if len(held) >= least_values:
                    scores[p, kind] = (10 * sum(held) // (10 * len(vs) + 27), len(held))
        if scores == before:
            break
        before = scores
        more = defaultdict(int)
        for (p, v, c), k in edges.items():
            for kind in range(4):
                if k < 0 and (kind, c) in classes and scores.get((p, kind), (0,))[0] >= least_conf * 10**6:
                    more[kind, v] = max(more[kind, v], scores[p, kind][0])
        conf = {**more, **sure} if not set(more) & set(sure) else None
    out = {}
    for doc, ms in found.items():
        spans = []
        for m in ms:
            if m["kind"] >= 0:
                spans.append((m["kind"], m["start"], m["end"]))
                continue
            best = [(*scores[p, k], -k) for p in m["patterns"] for k in range(4) if (k, m["class"]) in classes and scores.get((p, k), (0,))[0] >= least_conf * 10**6]
            if best:
                spans.append((-max(best)[2], m["start"], m["end"]))
        out[doc] = sorted(spans)
    return out


def test_pii_contexts_find_unseen_identifiers(spark):
    """Planted contexts, against the rounds in plain loops; second-order contexts come through values that the first round found."""
    rng = random.Random(3)
    filler = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))
    texts = [f"{filler(4)} please reach me: user{i}@mail.example.com today {filler(3)}" for i in range(30)]
    texts += ["so please reach me: bob (at) example (dot) com today again"]  # 30: spelled out
    texts += [f"{filler(3)} call us on +1 (988) 555-{2000 + i} or write {filler(2)}" for i in range(200)]
    texts += [f"just call us on 5{10 + i} 1234 56{i % 10} or write" for i in range(20)]  # 231: no +, digits as the seeds have
    texts += [f"a fax number 5{10 + i} 1234 56{i % 10} here" for i in range(20)]  # 251: another context of the same values
    texts += ["a fax number 770 4321 880 here"]  # 271: reached through those values
    texts += ["order 555 1234 567 came in on a monday", "call us on monday or write", "room 12 of 3 on floor 7", ""]
    out = {r.doc_id: r for r in pii.extract(frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])).collect()}
    want = brute_bootstrap({i: pii.mentions_of(t) for i, t in enumerate(texts)})
    assert {i: [tuple(s) for s in r.spans] for i, r in out.items()} == want
    found = lambda i: [(pii.KINDS[k], texts[i][a:z]) for k, a, z in want[i]]
    assert found(30) == [("email", "bob (at) example (dot) com")] and not out[30].base
    assert all(found(k) == [("phone", f"5{k - 221} 1234 56{(k - 231) % 10}")] and not out[k].base for k in range(231, 251))
    assert found(271) == [("phone", "770 4321 880")]
    assert not any(want[k] for k in range(272, 276))
    assert all(out[i].base == out[i].spans for i in range(30))


def test_pii_awkward(spark):
    rows = [*awkward(), (50, "é mail a@b.co, 10.0.0.1 and +1 (988) 555-2485 4539578763621486", "en", "s", 1)]
    got = pii.extract(frame(spark, rows, CLASH))
    want = sorted(((r[0], [tuple(x) for x in brute_spans(r[1] or "")]) for r in rows), key=repr)
    assert sorted(((r.doc_id, [(pii.KINDS[s[0]], s[1], s[2]) for s in r.base]) for r in got.collect()), key=repr) == want
    assert pii.extract(frame(spark, [])).count() == 0


# 2. SimHash


def brute_fingerprint(text, width=4):
    words = WS.findall((text or "").translate(UPPER))
    parts = [" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_fingerprints(spark):
    rows = awkward()
    got = [(r.doc_id, r.fp & (2**64 - 1)) for r in simhash.fingerprints(frame(spark, rows, CLASH)).collect()]
    assert sorted(got, key=repr) == sorted(((r[0], brute_fingerprint(r[1])) for r in rows), key=repr)
    h = spark.createDataFrame([("ab cd",)], "t string").select(F.xxhash64("t")).first()[0]
    assert h & (2**64 - 1) == xxhash.xxh64_intdigest(b"ab cd", 42)


@pytest.mark.parametrize("tau,segments,chain", [(4, 5, 1), (4, 5, 2), (4, 5, 3), (4, 8, 3), (6, 7, 2)])
def test_simhash_ring_loses_no_pair(tau, segments, chain):
    ring, rng = simhash.Ring(tau, segments, chain), random.Random(segments)
    for _ in range(800):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, tau)))
        asked = [s for s in range(segments) if simhash._signed(diff & (ring.mask(s, chain) & (2**64 - 1))) in ring.flips(s)]
        full = [s for s in asked if all(bin(diff & (ring.mask(s, n) & (2**64 - 1))).count("1") <= ring.budget(n) for n in range(chain, segments))]
        assert full


@pytest.mark.parametrize("taus", [(4,), (2, 6)])
def test_simhash_components(spark, monkeypatch, taus):
    rng = random.Random(4)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for f in list(fps):
        for n in (1, 2, 3, 4, 5, 6, 7):
            fps.append(f ^ sum(1 << b for b in rng.sample(range(64), n)))
    fps += fps[:30]
    want = components(len(fps), lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= taus[-1])
    frame_ = spark.createDataFrame([(i, 7, simhash._signed(f)) for i, f in enumerate(fps)], "doc_id long, text_hash long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a: frame_)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(None, taus=taus).collect()}
    assert [got[i] for i in range(len(fps))] == want


def test_simhash_similarity(spark):
    """Components of links at similarity 0.8 or 4 bits, against all pairs."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(5))
    rows = []
    for k in range(40):
        base = [word() for _ in range(rng.choice((30, 200, 600)))]
        for c in range(4):
            text = list(base)
            for at in rng.sample(range(len(base)), rng.choice((0, 1, 2, len(base) // 60, len(base) // 40))):
                text[at] = word()
            rows.append((k * 10 + c, " ".join(text), "en", "s", 1))
    rows += [(900, None, "en", "s", 1), (901, "", "en", "s", 1), (902, "One two", "en", "s", 1), (903, "one  TWO", "en", "s", 1)]
    sets = {r[0]: set(simhash.shingles(r[1], 5).tolist()) for r in rows}
    fps = {r[0]: simhash.fingerprint(r[1], 5) & (2**64 - 1) for r in rows}
    root = {d: d for d in sets}
    far = 0
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and ((fps[a] ^ fps[b]).bit_count() <= 4 or (sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))):
                far += (fps[a] ^ fps[b]).bit_count() > 6
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {d: new if r == old else r for d, r in root.items()}
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame(spark, rows, CLASH), width=5, similarity=0.8).collect()}
    assert far > 10 and got == root


def test_one_bucket_of_many_texts(spark, monkeypatch):
    """2,000 texts share one shingle, which comes first in everyone's order; the bucket's least text is like no other."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(5))
    rows = []
    for k in range(500):
        base = [word() for _ in range(rng.choice((40, 90)))]
        for c in range(4):
            text = list(base)
            for at in rng.sample(range(len(base)), c % 3):
                text[at] = word()
            rows.append((k * 4 + c, "one two three four five " + " ".join(text), "en", "s", 1))
    hashes = {r[0]: r[0] for r in spark.createDataFrame(rows, "i long, t string, l string, s string, n long").select("i", F.xxhash64("t").alias("h")).orderBy("h").limit(1).collect()}
    least = next(iter(hashes))
    rows = [r if r[0] != least else r for r in rows if r[0] // 4 != least // 4 or r[0] == least]
    common = simhash.shingles("one two three four five", 5)[0]

    def first(tallies):
        rank = np.roll(np.arange(1 << simhash.RARITY_BITS, dtype=np.uint64), int(common & simhash._LOW))
        assert rank[int(common & simhash._LOW)] == 0
        return rank

    monkeypatch.setattr(simhash, "rarity", first)
    sets = {r[0]: set(simhash.shingles(r[1], 5).tolist()) for r in rows}
    holders = defaultdict(list)
    for d, x in sets.items():
        for h in x:
            if h != int(common):
                holders[h].append(d)
    both = Counter((a, b) for ds in holders.values() for a in ds for b in ds if a < b)
    fps = {r[0]: simhash.fingerprint(r[1], 5) & (2**64 - 1) for r in rows}
    links = [(a, b) for (a, b), n in both.items() if (fps[a] ^ fps[b]).bit_count() <= 4 or n + 1 >= 0.8 * (len(sets[a]) + len(sets[b]) - n - 1)]
    root = {d: d for d in sets}
    for a, b in sorted(links) * 4:
        root[a] = root[b] = min(root[a], root[b])
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame(spark, rows), width=5, similarity=0.8).collect()}
    assert root[least] == least and got == root and 300 < len(set(root.values())) < len(rows)


def test_the_order_of_rarity_holds_every_set(spark):
    rank = np.random.default_rng(2).permutation(1 << simhash.RARITY_BITS).astype(np.uint64)
    h = np.random.default_rng(1).integers(0, 1 << 63, 3000, np.uint64)
    x, y = simhash.ranked(np.append(h, h[:9]), rank), simhash.ranked(h[:2000], rank)
    assert len(x) == 3000 and len(y) == 2000 and np.isin(y, x).all() and (np.diff(x.astype(np.float64)) >= 0).all()
    rows = simhash.fingerprints(frame(spark), width=5, tallied=True)
    total = Counter(int(s & simhash._LOW) for r in awkward() for s in simhash.shingles(r[1], 5))
    got = simhash.rarity(rows.where("tally is not null"))
    want = np.bincount(list(total.elements()), minlength=len(got))
    assert (np.diff(want[np.argsort(got)]) >= 0).all()


def test_sketches_differ_no_more_than_sets(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.choice((3, 50, 400)))) for _ in range(12)]
    df = frame(spark, [(k, t, "en", "s", 1) for k, t in enumerate(texts)])
    wanted = df.select(F.xxhash64("text").alias("text_hash"), F.col("doc_id").alias("rep"))
    held, sketches = ({r[0]: r[1] for r in simhash.shingle_sets(df, wanted, "doc_id", "text", 5, w).collect()} for w in (True, False))
    sets = [(set(np.frombuffer(held[h], np.uint64).tolist()), sketches[h]) for h in held]
    assert len(held) == len(sketches) == len({r.text_hash for r in wanted.collect()})
    for x, p in sets:
        for y, q in sets:
            assert sum(((i ^ j) & (2**64 - 1)).bit_count() for i, j in zip(p, q)) <= len(x ^ y)


def test_clashing_names_stay(spark):
    """Columns named like the operators' own stay as they are."""
    names = ("hash", "nth", "kept_id", "c0", "c1", "c7", "__hash", "__n", "fp", "th", "__th", "__id", "__copy", "__times", "__doc_id", "tokens", "bad_id", "lang_pred", "__text")
    df = frame(spark, None, names)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and kept.count() == simhash.keep_one(frame(spark)).count()
    bench = spark.createDataFrame([(1, awkward()[0][1])], "item_id long, text string")
    assert decontam.remove(df, bench).columns == df.columns
    mixed = mixing.mix(df, mixing.tree(), mixing.WEIGHTS)
    assert mixed.columns == df.columns and mixed.count() == mixing.mix(frame(spark), mixing.tree(), mixing.WEIGHTS).count()
    assert substring.dedup(df).count() == df.count()


def test_simhash_awkward(spark):
    rows = awkward()
    got = simhash.near_duplicates(frame(spark, rows, CLASH))
    fps = [brute_fingerprint(r[1]) for r in rows]
    root = components(len(rows), lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 4)
    least = {c: min((rows[i][0] for i in range(len(rows)) if root[i] == c and rows[i][0] is not None), default=None) for c in root}
    assert tuples(got, "doc_id", "component_id") == sorted(((r[0], least[c]) for r, c in zip(rows, root)), key=repr)
    kept = simhash.keep_one(frame(spark, rows, CLASH))
    assert simhash.keep_one(frame(spark, rows, CLASH), width=5, similarity=0.8).columns == kept.columns
    assert kept.count() == len(set(root)) and kept.columns == frame(spark, rows, CLASH).columns
    assert simhash.near_duplicates(frame(spark, [])).count() == simhash.keep_one(frame(spark, [])).count() == 0


def test_components_of_long_paths(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 90), (90, 95)]
    got = dict(tuples(shared.connected_components(spark.createDataFrame(edges, "u long, v long"))))
    assert all(got[k] == 0 for k in range(61)) and got[95] == got[100] == 90


# 3. decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_contamination(docs, items, width=13):
    out = []
    words = [(i, WORD.findall((t or "").translate(UPPER))) for i, t in items]
    for doc_id, text in docs:
        w = WORD.findall((text or "").translate(UPPER))
        hit, named = set(), set()
        for item, x in words:
            n = min(width, len(x))
            for s in range(len(x) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == x[s : s + n]:
                        hit |= set(range(p, p + n))
                        named.add("" if item is None else str(item))
        out.append((doc_id, len(w), len(hit), len(named), sha(",".join(sorted(named)).encode()), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_decontamination(spark):
    rng = random.Random(6)
    word = lambda: rng.choice(["the", "of", "AND", "Été", "x9", "zebra", "quartz", "lamp"])
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 5, 13, 20, 30])))) for k in range(8)]
    items += [(8, None), (9, ""), (None, "null id item words"), (9, items[0][1]), (9, items[0][1])]
    docs = [(r[0], r[1]) for r in awkward()]
    for k in range(40):
        t = " ".join(word() for _ in range(rng.randint(0, 60)))
        item = rng.choice(items)[1] or ""
        docs.append((200 + k, f"{t} {item[: rng.randint(0, 200)].upper()}, {t}" if k % 2 else t))
    docs += [(300, "!null ID-item words" + " pad" * 80), docs[-1], docs[-1]]
    table = frame(spark, [(i, t, "en", "s", 1) for i, t in docs], CLASH)
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as term", "2 as item", "3 as cf")
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = brute_contamination(docs, items)
    assert tuples(decontam.contamination(table, bench), *cols) == want
    kept = decontam.remove(table, bench)
    assert kept.count() == sum(not w[-1] for w in want) and kept.columns == table.columns
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(table, none).where("n_hit > 0 or contaminated").count() == 0
    assert decontam.contamination(frame(spark, []), bench).count() == 0


def test_decontamination_proximity(spark):
    bench = spark.createDataFrame([(1, "common alpha common beta common")], "item_id long, text string")
    docs = [(1, "common alpha common beta common", "en", "s", 1), (2, "alpha common common common beta", "en", "s", 1), (3, "alpha " + "common " * 40 + "beta", "en", "s", 1)]
    index = decontam.Index(frame(spark, docs), bench)
    assert tuples(index.phrases(), "doc_id") == [(1,)]
    assert tuples(index.proximity(3), "doc_id", "item_id") == [(1, "1"), (2, "1")]


def test_a_long_item_costs_what_it_matches(spark):
    """20,000 words in one item, a third of them in a document: windows meet by place, not each with each."""
    rng = random.Random(14)
    words = ["w%d" % rng.randint(0, 3000) for _ in range(20_000)]
    docs = [(1, " ".join(["x"] * 10 + words[500:7000] + ["y"] * 5), "en", "s", 1), (2, "w1 w2 w3", "en", "s", 1)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    began = time.time()
    got = decontam.contamination(frame(spark, docs), bench).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in got] == [(6515, 6500, True), (3, 0, False)]
    assert time.time() - began < 120


# 4. lines


def brute_lines(rows, least=1, most=10):
    key = lambda x: x.strip(" \t\n\r\x0b\x0c").translate(UPPER)
    found = Counter(k for r in rows for k in {key(x) for x in (r[1] or "").split("\n")})
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or found[key(x)] < most]
        out.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_lines(spark):
    rows = awkward()
    index = linededup.LineIndex.build(frame(spark, rows, CLASH))
    assert tuples(index.apply(frame(spark, rows, CLASH))) == brute_lines(rows)
    assert linededup.LineIndex.build(frame(spark, [])).apply(frame(spark, rows)).where("n_dropped > 0").count() == 0
    assert index.apply(frame(spark, [])).count() == 0


def test_lines_deletion_undoes_insertion(spark):
    rows = awkward()
    old, new = rows[::2], rows[1::2]
    index = linededup.LineIndex.build(frame(spark, old), min_docs=4)
    grown = index.insert(frame(spark, new))
    assert tuples(grown.apply(frame(spark, rows))) == brute_lines(rows, most=4)
    back = grown.delete(frame(spark, new))
    assert tuples(back.counts) == tuples(index.counts)
    assert tuples(back.apply(frame(spark, old))) == brute_lines(old, most=4)


@pytest.mark.parametrize("shards", [None, 3])
def test_lines_meet_large_filters_by_shard(spark, monkeypatch, shards):
    monkeypatch.setattr(linededup, "BROADCAST_FILTERS", 0)
    seen, plain = [], linededup.LineIndex._by_shard
    monkeypatch.setattr(linededup.LineIndex, "_by_shard", lambda self, lines: seen.append(1) or plain(self, lines))
    rows = awkward() + [(200 + k, "\n".join(f"line {j}" for j in range(k % 7, 40)), "en", "s", 1) for k in range(30)]
    assert tuples(linededup.LineIndex.build(frame(spark, rows), shards=shards).apply(frame(spark, rows))) == brute_lines(rows) and seen


def test_lines_refuse_to_delete_what_is_not_there(spark):
    rows = [(k, "one\ntwo", "en", "s", 1) for k in range(12)]
    index = linededup.LineIndex.build(frame(spark, rows))
    with pytest.raises(ValueError, match="1 texts"):
        index.delete(frame(spark, [*rows, rows[0]]))
    with pytest.raises(ValueError, match="1 texts"):
        index.delete(frame(spark, [(0, "one", "en", "s", 1)]))  # its line is known, the document is not
    assert index.delete(frame(spark, rows)).counts.isEmpty() and index.insert(frame(spark, [])).counts.count() == 2


def test_cuckoo_filter():
    keys = [hashlib.md5(str(k).encode()).digest() for k in range(3000)]
    as_array = lambda ks: np.frombuffer(b"".join(ks), np.uint8).reshape(-1, 16)
    made = linededup.Cuckoo.of(keys[:2000])
    assert made.contains(as_array(keys[:2000])).all()
    assert made.contains(as_array(keys[2000:])).mean() < 0.01
    assert all(map(made.delete, keys[:1000])) and made.contains(as_array(keys[1000:2000])).all()
    assert made.contains(as_array(keys[:1000])).mean() < 0.01
    tiny = linededup.Cuckoo.of([])
    assert not all(map(tiny.insert, keys[:100]))


# 5. substrings


def brute_substrings(texts, length):
    raw = [(t or "").encode() for t in texts]
    at = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if at[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(r), sum(gone), spans, bytes(x for x, y in zip(r, gone) if not y)))
    return out


def test_suffix_array_and_common_prefixes():
    rng = random.Random(3)
    for k in range(600):
        n, a = rng.randint(1, 60), rng.choice([1, 2, 3, 5, 200])
        t = np.array([rng.randint(0, a) for _ in range(n)], np.uint8)
        t = np.concatenate([t, t, t[: rng.randint(0, n)]]) if k % 3 == 0 else t
        b = t.tobytes()
        want = sorted(range(len(b)), key=lambda i: b[i:])
        got = suffix.suffix_array(t)
        assert got.tolist() == want == suffix._doubled(t).tolist()
        lcp = suffix.permuted_lcp(t, got)
        for x, i in enumerate(want):
            j, n = want[x - 1] if x else len(b), 0
            while max(i, j) + n < len(b) and b[i + n] == b[j + n]:
                n += 1
            assert lcp[i] == n


@pytest.mark.parametrize("alphabet", ["ab", "abcdé\n"])
def test_substrings(spark, alphabet):
    rng = random.Random(5)
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300))) for _ in range(5)]
    texts = [None, "", "x" * 500] + [b[rng.randint(0, 30) :] + "".join(rng.choice(alphabet) for _ in range(40)) + rng.choice(base)[:200] for b in base * 6] + [base[0]] * 3
    df = frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)], CLASH)
    want = [(i, *w) for i, w in enumerate(brute_substrings(texts, 24))]
    for shard_bytes in (1 << 21, 600):  # the second cuts anchors into pieces
        got = substring.dedup(df, length=24, gram=8, shard_bytes=shard_bytes)
        assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()) == want


def test_a_passage_in_many_surroundings_is_split(spark, monkeypatch):
    """The edges of one passage, different in every document, go beyond a shard of their own key and are counted by start."""
    rng = random.Random(12)
    around = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage = around(120)
    texts = [around(rng.randint(0, 40)) + passage + around(rng.randint(0, 40)) for _ in range(150)] + [passage[:60] + "x" + passage[61:]]
    seen, plain = [], substring._starts
    monkeypatch.setattr(substring, "_starts", lambda pieces, length: seen.append(pieces.count()) or plain(pieces, length))
    got = substring.dedup(frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)]), length=40, gram=8, shard_bytes=700)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()) == [(i, *w) for i, w in enumerate(brute_substrings(texts, 40))]
    assert seen and seen[0] > 0


def test_recursion_at_any_alphabet(monkeypatch):
    monkeypatch.setattr(suffix, "NAMES", 1 << 40)
    t = np.random.default_rng(3).integers(0, 40, 60_000).astype(np.uint8)
    assert (suffix.suffix_array(t) == suffix._doubled(t)).all()


def test_substrings_awkward(spark):
    rows = awkward()
    got = substring.dedup(frame(spark, rows, CLASH))
    want = sorted(((r[0], *w) for r, w in zip(rows, brute_substrings([r[1] for r in rows], 400))), key=repr)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()), key=repr) == want
    assert substring.dedup(frame(spark, [])).count() == 0


def test_long_texts_are_anchored_in_blocks(monkeypatch):
    monkeypatch.setattr(substring, "BLOCK", 1000)
    rng = random.Random(1)
    text = bytes(rng.choice(b"abc") for _ in range(5000))
    h = substring.gram_hashes(np.frombuffer(text, np.uint8), 64)
    got = substring.anchors(text, 400, 64)
    covered = [(int(a), s) for a, f, n in zip(got[1], got[2], got[3]) for s in range(f, f + n)]
    high = [int(x) >> 20 for x in h]
    assert covered == [(min(range(p, p + 337), key=lambda i: (high[i], i)), p) for p in range(5000 - 399)]


# 6. sharding


def test_sharding(spark):
    rows = awkward()
    got = sharding.assign(frame(spark, rows, CLASH), [1.0] * 5, grown=[1.0] * 6).collect()
    want = sorted(((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows), key=repr)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == want
    assert all(r.grown_shard in (r.shard, 5) for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({(r.doc_id, r.shard) for r in got}) == len({r.doc_id for r in got})
    assert sharding.assign(frame(spark, []), [1.0]).count() == 0


def brute_rendezvous(key, weights):
    """The shard of the greatest -weight / ln(u) by a plain loop; ties to the smaller number."""
    best = None
    for i, w in enumerate(weights):
        if w > 0:
            h = xxhash.xxh64_intdigest(struct.pack("<i", i), xxhash.xxh64_intdigest(key.encode(), 42))
            score = -w / math.log(((h >> 11) + 0.5) / 2**53)
            if best is None or score > best[0]:
                best = (score, i)
    return best[1]


def test_sharding_equals_an_arg_max(spark):
    rows = [(k, "t", "en", "s", 1) for k in [*range(-40, 300), None]]
    weights, grown = [1.0, 0.0, 2.5, 0.5], [1.0, 0.0, 2.5, 0.5, 3.0]
    got = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.assign(frame(spark, rows), weights, grown=grown).collect()}
    assert got == {r[0]: tuple(brute_rendezvous("null" if r[0] is None else str(r[0]), w) for w in (weights, grown)) for r in rows}


def test_sharding_follows_weights(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    n = Counter(r.shard for r in sharding.assign(df, [1.0, 2.0, 0.0, 1.0]).collect())
    assert n[2] == 0 and abs(n[1] - 10000) < 400 and abs(n[0] - 5000) < 400


# 7. token ids

MODEL = public_tokenizers.path("byte_bpe_50k.json")


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(MODEL)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_encoder_equals_library():
    rng, alphabet = random.Random(1), list(" \n\tab'sé1. 　\x1c\0日<|endoftext|>")
    encoder = tokens.Encoder(open(MODEL, encoding="utf-8").read(), memory=200)
    for _ in range(400):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(4)]
        assert [x.tolist() for x in encoder.encode(texts)] == reference_ids(texts)


def test_encoder_learns_words_once_whatever_marks_and_line_ends_follow():
    rng, words, ends = random.Random(2), [f"w{'abcdefghij'[k % 10]}{'stu'[k // 10]}é" for k in range(30)], ["", ".", ",", "...", "?!", "'", ".\n"]
    pieces = [w + e + (v if e[-1:] == "\n" else "") for w in words for e in ends for v in words]
    texts = [" ".join(rng.sample(pieces, 50)) for _ in range(200)]
    encoder = tokens.Encoder(open(MODEL, encoding="utf-8").read())
    assert [x.tolist() for x in encoder.encode(texts)] == reference_ids(texts)
    assert len(set(pieces)) > 1000 and len(encoder.at) <= 2 * len(words) + len(ends) + len(words) * 2  # with and without a space
    encoder, alphabet = tokens.Encoder(open(MODEL, encoding="utf-8").read(), memory=200), list(" \n\t.,'#sabé1½日\u0301\u3000\x1c\0") + ["it's", "\n\n", "Word.\nNext"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    assert [x.tolist() for k in range(0, len(texts), 8) for x in encoder.encode(texts[k : k + 8])] == reference_ids(texts)


def test_token_files(spark):
    rows = awkward()
    path = shared.new_path(spark, "tokens")
    tokens.write_ids(frame(spark, rows, CLASH), path, MODEL)
    back = tokens.read_ids(spark, path).collect()
    assert sorted((repr(r.doc_id), r.ids) for r in back) == sorted((repr(r[0]), x + [0]) for r, x in zip(rows, reference_ids([r[1] for r in rows])))
    got = sorted(tokens.digest(spark, path).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    by = defaultdict(list)
    for r in back:
        by[r.doc_id].append((len(r.ids), zlib.crc32(struct.pack(f"<{len(r.ids)}I", *r.ids))))
    assert all((r.n_tokens, r.ids_crc32) in by[r.doc_id] for r in got)
    assert [r.doc_id for r in tokens.read_ids(spark, path, [24]).collect()] == [24]
    empty = shared.new_path(spark, "tokens")
    tokens.write_ids(frame(spark, []), empty, MODEL)
    assert tokens.digest(spark, empty).count() == 0


def test_special_tokens_are_the_library_s(spark):
    texts = ["one <|endoftext|> two", "<|endoftext|>", "a<|endoftext|>", "<|endoftext", "plain  words <|endoftext|> \n"]
    path = shared.new_path(spark, "tokens")
    tokens.write_ids(frame(spark, [(k, t, "en", "s", 1) for k, t in enumerate(texts)]), path, MODEL)
    got = {r.doc_id: r.ids for r in tokens.read_ids(spark, path).collect()}
    assert [got[k] for k in range(len(texts))] == [[*x, 0] for x in reference_ids(texts)]
    assert len(got[1]) == 2


def test_token_files_hold_indexes_that_lookups_use(spark):
    path = shared.new_path(spark, "tokens")
    df = spark.range(0, 40000, 2).select(F.col("id").alias("doc_id"), F.lit("a few words").alias("text"))
    tokens.write_ids(df, path, MODEL)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files = spark.read.orc(path).inputFiles()
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(files[0]), jvm.org.apache.orc.OrcFile.readerOptions(conf))
    footer = reader.rows().readStripeFooter(reader.getStripes()[0]).toString()
    assert "ROW_INDEX" in footer and "BLOOM_FILTER_UTF8" in footer and "DIRECT_V2" in footer and reader.getRowIndexStride() == 1000

    def scanned(ids):
        rows = tokens.read_ids(spark, path, ids)
        found = rows.collect()
        plan = rows._jdf.queryExecution().executedPlan()
        return found, plan.collectLeaves().head().metrics().apply("numOutputRows").value()

    found, n = scanned([20000])
    assert [r.doc_id for r in found] == [20000] and n <= 4096  # row groups that hold it, not 20,000 rows
    found, n = scanned([20001])  # inside the range of a row group, but not in its Bloom filter
    assert not found and n == 0


# 8. mixing


def test_mixing_passes_shortage_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 1000), ("b", "x", 500), ("b", "y", 500), ("b", "z", 0)], "d string, s string, supply long")
    quota = lambda **how: {(r.d, r.s): r.quota for r in mixing.deal(leaves, ["d", "s"], **how).collect()}
    got = quota(weights={"d": {"a": 1.0, "b": 1.0}}, budget_ratio=0.5, max_epochs=1)
    assert got == {("a", "x"): 10, ("a", "y"): 493, ("b", "x"): 251, ("b", "y"): 251, ("b", "z"): 0}
    got = quota(weights={"d": {"a": 9.0, "b": 1.0}}, budget_ratio=0.75, max_epochs=1)
    assert got[("a", "x")] == 10 and got[("a", "y")] == 1000 and got[("b", "x")] == got[("b", "y")] == 249
    got = quota(weights={"s": {"x": 0.0}}, budget_ratio=1.0, max_epochs=2)
    assert ("a", "x") not in got or got[("a", "x")] == 0


def test_mixing_selection(spark):
    rows = awkward()
    df = frame(spark, rows, CLASH)
    taken = mixing.select(df, mixing.tree(), mixing.WEIGHTS, 1.0, 4, 17).collect()
    supply, units = Counter(), Counter()
    for i, t, lang, source, _ in rows:
        leaf = ("web" if re.fullmatch("src[0-9]", source or "") else "curated", lang or mixing.NONE, source or mixing.NONE)
        supply[leaf] += len(WS.findall(t or ""))
        units[(i, t, leaf)] += 1
    leaves = spark.createDataFrame([(*k, v) for k, v in supply.items()], "domain string, lang string, source string, supply long")
    quota = {(r.domain, r.lang, r.source): r.quota for r in mixing.deal(leaves, ["domain", "lang", "source"], mixing.WEIGHTS, 1.0, 4).collect()}
    got, each = Counter(), Counter()
    for r in taken:
        got[(r.domain, r.lang, r.source)] += r["take"]
        each[(r.doc_id, r.th, r.lang, r.source, r.epoch)] += 1
        assert r["take"] <= r.tokens
    assert all(got[k] == q for k, q in quota.items()) and max(each.values()) == 1
    mixed = mixing.mix(df, mixing.tree(), mixing.WEIGHTS)
    assert mixed.count() == sum(r.n_rows for r in taken) and mixed.columns == df.columns
    assert mixing.mix(frame(spark, []), mixing.tree(), mixing.WEIGHTS).count() == 0


# 9. language


def test_kneser_ney_probabilities_sum_to_one():
    table = langid.symbol_table()
    sym = langid.symbols(["banana bandana", "cabana"], table)
    models = langid.build({"x": np.unique(langid.grams(*sym), return_counts=True)})
    letters = [ord(c) for c in "abcdn "] + [0x3B1]  # the alphabet and one character for all others
    for context in ("ban", "and", "zzz", " ca"):
        packed = sum(ord(c) << 16 * (3 - k) for k, c in enumerate(context))
        p = np.exp(models.score(np.array([packed | x for x in letters], np.uint64)))
        assert abs(p.sum() - 1) < 1e-3


def brute_kneser_ney(texts, order):
    """p(character, context) of interpolated Kneser-Ney by its formula, over Counters of strings."""
    top = Counter(x[k - order + 1 : k + 1] for t in texts for x in [" " * (order - 1) + t] for k in range(order - 1, len(x)))
    levels = [top]
    for k in range(order - 1, 0, -1):
        levels.insert(0, Counter(g[1:] for g in levels[0]))
    alphabet = len({g[-1] for g in top}) + 1  # one for all characters never seen

    def p(c, context, k):
        if not k:
            return 1 / alphabet
        own = levels[k - 1]
        ones, twos = sum(n == 1 for n in own.values()), sum(n == 2 for n in own.values())
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        after = {g: n for g, n in own.items() if g[:-1] == context}
        lower = p(c, context[1:], k - 1)
        if not after:
            return lower
        n = own.get(context + c, 0)
        return (max(n - d, 0) + d * len(after) * lower) / sum(after.values())

    return p


def test_kneser_ney_equals_its_formula():
    table = langid.symbol_table()
    texts = [" banana bandana cabana an ban", " a cab and a band", " nab"]
    models = langid.build({"x": np.unique(langid.grams(*langid.symbols([t[1:] for t in texts], table)), return_counts=True)})
    p = brute_kneser_ney(texts, langid.ORDER)
    contexts = {t[k : k + 3] for t in texts for k in range(len(t) - 2)} | {"zzz", "  b", "ana", "czb"}
    for context in contexts:
        for c in "abcdnz ":
            packed = sum(ord(x) << 16 * (3 - k) for k, x in enumerate(context + c))
            got = float(np.exp(models.score(np.array([packed], np.uint64)))[0, 0])
            assert abs(got - p(c, context, langid.ORDER)) < 1e-5, (context, c)


def test_symbols_of_texts():
    table = langid.symbol_table()
    sym, starts = langid.symbols(["Ab  1c", "", "É"], table)
    assert "".join(map(chr, sym)) == " ab c  é" and starts.tolist() == [0, 5, 6]


def test_language(spark):
    rng = random.Random(8)
    make = lambda v: " ".join("".join(rng.choice(v) for _ in range(5)) for _ in range(60))
    rows = [(1000 + k, make("aeioubcd") if k % 2 else make("öäüxyzkw"), "aa" if k % 2 else "bb", "s", 1) for k in range(80)]
    df = frame(spark, rows + awkward()[12:18], CLASH)
    models = langid.train(frame(spark, rows).where("doc_id < 1060"))
    got = {r.doc_id: r for r in langid.classify(df, models, carry=["doc_id", "th"]).collect()}
    assert all(got[r[0]].lang_pred == r[2] and not got[r[0]].rejected and 0.5 < got[r[0]].score <= 1 for r in rows)
    assert all((got[k].lang_pred, got[k].score, got[k].rejected) == ("und", 0.0, True) for k in (20, 21, 22, 23))
    nothing = langid.train(frame(spark, []))
    assert {r.lang_pred for r in langid.classify(df, nothing).collect()} == {"und"}
    assert langid.classify(frame(spark, []), models).count() == 0


def test_language_rejects_what_no_model_knows(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(80)), "aa", "s", 1) for k in range(60)]
    odd = [(100, "ψυχη κοσμος " * 40, "aa", "s", 1), (101, "alpha beta gamma", "aa", "s", 1)]
    models = langid.train(frame(spark, rows))
    got = {r.doc_id: r.rejected for r in langid.classify(frame(spark, odd), models, carry=["doc_id"]).collect()}
    assert got == {100: True, 101: False}


# 10. quality


def brute_quality(text):
    text = text or ""
    words, lines = WS.findall(text), text.split("\n")
    win = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(win)
    rep = {p for i, w in enumerate(win) if n[w] > 1 for p in range(i, i + 8)}
    worded = [x for x in lines if WS.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(worded) - len(set(worded)), len(rep), len(words) < 20 or 100 * len(rep) > 30 * len(words)


def test_quality_measures(spark):
    rng = random.Random(7)
    rows = [*awkward()]
    rows += [(400 + k, " ".join(rng.choice("ab") for _ in range(k)), "en", "s", 1) for k in range(0, 40)]
    got = quality.measure(frame(spark, rows, CLASH))
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert tuples(got, *cols) == sorted(((r[0], *brute_quality(r[1])) for r in rows), key=repr)
    assert quality.measure(frame(spark, [])).count() == 0


def test_quality_lines_of_several_languages(spark):
    lines = ["Alle Rechte vorbehalten.", "Lire la suite.", "Leer más.", "https://a.b/c http://d.e.", "12 34 56 78.", "यह एक वाक्य है।", "这是一句话。", "C'est une phrase."]
    rows = [(1, "\n".join(lines), "x", "s", 1)]
    assert quality.measure(frame(spark, rows)).first().kept_text.split("\n") == lines[5:]
    assert quality.measure(frame(spark, rows), phrases={"xx": ("phrase",)}).first().kept_text.split("\n") == [*lines[:3], *lines[5:7]]


def test_quality_lines(spark):
    good = "This sentence is long enough to hold a thought, and it ends as one should."
    other = "Another one follows that says something else entirely, so that no window of words comes twice."
    rows = [(1, "\n".join([good, other, "Home | About | Contact | Login", "Accept all cookies.", "no end here", "", "a** b&& c%% d."]), "en", "s", 1)]
    rows += [(2, "\n".join(["Home | About | Contact"] * 30 + [good]), "en", "s", 1), (3, (good + " ") * 1, "en", "s", 1)]
    got = {r.doc_id: r for r in quality.measure(frame(spark, rows)).collect()}
    assert got[1].kept_text == f"{good}\n{other}\n" and got[1].kept
    assert not got[2].kept and got[2].lost_chars > 0
    assert got[3].base_failed and not got[3].kept and got[3].lost_chars == 0
