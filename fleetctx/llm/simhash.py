"""SimHash near-duplicates: fingerprints, pigeonring candidate chains, exact Hamming links, components.

The 64 bits lie on a ring of tau + 1 segments. If two fingerprints differ in at most tau bits, some start
exists from which every chain of l consecutive segments differs in at most floor(l * tau / segments) bits.
A chain of `chain` segments is looked up by equality: one side is stored under its chain bits, the other
asks for every chain value within those budgets. Longer chains are then tested on the pair, and only
survivors get the full Hamming check. No pair is lost and no bucket is capped.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import connected_components, discard, documents, materialize, merged, unveiled, veiled

SEED = 42


def shingles(text: str | None, width: int) -> np.ndarray:
    """Hashes of the word shingles of a whole text, repeats included; none where it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z fall, only ASCII white space parts
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes + 1) - sizes - 1
    span = min(width, len(words))
    ends = (starts + sizes)[span - 1 :]
    parts = map(joined.__getitem__, map(slice, starts[: len(ends)].tolist(), ends.tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(ends))


def fold_bits(h: np.ndarray) -> int:
    """Signed 64-bit SimHash of shingle hashes; 0 where there is none."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 20):
        bits = np.unpackbits(h[a : a + (1 << 20)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    set_bits = np.packbits(ones * 2 > len(h), bitorder="little")
    return int(set_bits.view(np.int64)[0])


def fingerprint(text: str | None, width: int = 4) -> int:
    """Signed 64-bit SimHash of a whole text; 0 where it has no word."""
    return fold_bits(shingles(text, width))


#: Shingles are counted by the low bits of their hashes, over all rows: counters of fixed size that put rare shingles first.
RARITY_BITS = 18
_LOW = np.uint64((1 << RARITY_BITS) - 1)
#: Sums of the counters that reach the driver.
TALLY_PARTS = 8


def slices(batches, rows: int = 500):
    """Arrow batches in parts of some rows, so that few texts are Python strings at a time."""
    for b in batches:
        for k in range(0, len(b), rows):
            yield b.slice(k, rows)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, tallied: bool = False) -> DataFrame:
    """One row (doc_id, text_hash, fp) for each row of docs. A null text counts as empty.

    tallied: also a column tally, null but for one more row of each task, which holds its counters of shingles.
    """

    def batches(it):
        tally = np.zeros(1 << RARITY_BITS, np.int64)
        for b in slices(it):
            fps = []
            for t in b.column(2).to_pylist():
                h = shingles(t, width)
                fps.append(fold_bits(h))
                if tallied and len(h) > 1 << RARITY_BITS:
                    tally += np.bincount((h & _LOW).astype(np.int64), minlength=len(tally))
                elif tallied:
                    np.add.at(tally, (h & _LOW).astype(np.int64), 1)
            columns = [b.column(0), b.column(1), pa.array(fps, pa.int64())]
            if tallied:
                columns.append(pa.nulls(len(fps), pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "fp", "tally"][: len(columns)])
        if tallied:
            none = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, pa.array([zlib.compress(tally.tobytes(), 1)])], names=["doc_id", "text_hash", "fp", "tally"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(batches, "doc_id long, text_hash long, fp long" + (", tally binary" if tallied else ""))


def rarity(tallies: DataFrame) -> np.ndarray:
    """The rank of each counter, rarest first, from (tally); ties fall to the counter's number."""

    def add(it):
        total = np.zeros(1 << RARITY_BITS, np.int64)
        for b in it:
            for x in b.column(0).to_pylist():
                total += np.frombuffer(zlib.decompress(x), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)])], names=["tally"])

    some = max(TALLY_PARTS, math.isqrt(tallies.count()))  # sums of sums, so that no task reads all
    sums = tallies.select("tally").coalesce(some).mapInArrow(add, "tally binary")
    parts = sums.repartition(TALLY_PARTS).mapInArrow(add, "tally binary").collect()  # TALLY_PARTS arrays, whatever the input
    total = np.sum([np.zeros(1 << RARITY_BITS, np.int64), *(np.frombuffer(zlib.decompress(r.tally), np.int64) for r in parts)], axis=0)
    rank = np.empty(len(total), np.uint64)
    rank[np.argsort(total, kind="stable")] = np.arange(len(total), dtype=np.uint64)
    return rank


def ranked(h: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The set of shingle hashes in the order of rarity: each hash with its counter's rank in place of its low bits, on top."""
    u = np.unique(h)
    return np.sort(rank[(u & _LOW).astype(np.int64)] << np.uint64(64 - RARITY_BITS) | u >> np.uint64(RARITY_BITS))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Ring:
    """Segments, chain masks and the flips within budget for one (tau, segments, chain)."""

    def __init__(self, tau: int = 4, segments: int = 5, chain: int = 2):
        self.tau, self.segments, self.chain = tau, segments, chain
        cuts = [64 * k // segments for k in range(segments + 1)]
        self.parts = [list(range(cuts[k], cuts[k + 1])) for k in range(segments)]

    def budget(self, length: int) -> int:
        return length * self.tau // self.segments

    def bits(self, start: int, length: int) -> list[int]:
        return [b for k in range(length) for b in self.parts[(start + k) % self.segments]]

    def mask(self, start: int, length: int) -> int:
        return _signed(sum(1 << b for b in self.bits(start, length)))

    def flips(self, start: int) -> list[int]:
        """XOR masks of every difference that a chain from start may show."""
        out = []
        for n in range(self.budget(self.chain) + 1):
            for some in combinations(self.bits(start, self.chain), n):
                if all(sum(b in self.parts[(start + k) % self.segments] for b in some for k in range(length)) <= self.budget(length) for length in range(1, self.chain)):
                    out.append(_signed(sum(1 << b for b in some)))
        return out


def links(fps: DataFrame, tau: int = 4, segments: int = 5, chain: int = 2) -> DataFrame:
    """Distinct (u, v), u < v, that connect exactly the fingerprints connected by Hamming distance <= tau.

    fps: distinct (fp, group); pairs inside one group are known to be connected and are left out: a question whose chain value
    is stored for its own group alone goes no further, so a dense cluster that is one group is not compared with itself.
    Spark's size estimates do not see that explode() multiplies rows, so these too are merged joins: else they would be broadcast.
    """
    ring = Ring(tau, segments, chain)
    starts = range(segments)
    stored = fps.select(F.col("fp").alias("b"), F.col("group").alias("b_group"), F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.col("fp").bitwiseAND(F.lit(ring.mask(s, chain))).alias("k")) for s in starts])).alias("x")).select("b", "b_group", "x.s", "x.k")
    asks = [(s, f) for s in starts for f in ring.flips(s)]
    wanted = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(ring.mask(s, chain)).alias("m"), F.lit(f).alias("f")) for s, f in asks])
    asked = fps.select(F.col("fp").alias("a"), F.col("group").alias("a_group"), F.explode(wanted).alias("x")).select("a", "a_group", "x.s", F.expr("(a & x.m) ^ x.f").alias("k"))
    held = stored.groupBy("s", "k").agg(F.min("b_group").alias("lo"), F.max("b_group").alias("hi"))
    asked = merged(asked, held, ["s", "k"]).where("lo <> a_group or hi <> a_group").select("a", "a_group", "s", "k")
    on = (asked.s == stored.s) & (asked.k == stored.k) & (F.col("a") < F.col("b")) & (F.col("a_group") != F.col("b_group"))
    diff = F.col("a").bitwiseXOR(F.col("b"))
    for length in range(chain + 1, segments):
        mask = F.element_at(F.array(*[F.lit(ring.mask(s, length)) for s in starts]), asked.s + 1)
        on &= F.bit_count(diff.bitwiseAND(mask)) <= ring.budget(length)
    on &= F.bit_count(diff) <= tau
    return merged(asked, stored, on).select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()


def one_bit_links(fps: DataFrame) -> DataFrame:
    """(u, v) at Hamming distance 1: each fingerprint looks its 64 neighbours up; at most 64 links a fingerprint."""
    asked = fps.select(F.col("fp").alias("u"), F.explode(F.array(*[F.lit(_signed(1 << b)) for b in range(64)])).alias("m")).select("u", F.col("u").bitwiseXOR(F.col("m")).alias("v")).where("u < v")
    return merged(asked, fps.select(F.col("fp").alias("v")), "v").select("u", "v")


#: 64-bit words of a text's odd sketch.
SKETCH = 16
#: How many of its bucket each text meets before all that are still apart do.
STARS = 3
#: Flags by the low bits of a text's hash.
FILTER_BITS = 22


def prefix_keys(docs: DataFrame, rank: np.ndarray, text_col: str, width: int, similarity: float) -> DataFrame:
    """(key, text_hash, n, at): the rarest shingles of each text, as many as one of two similar sets must share one of.

    Of a set of n shingles at least similarity * n are in a set that similar, so the first n - ceil(similarity * n) + 1 in any order
    that all sets follow hold one they share. at: how many come before it. Copies within a task are given once.
    """
    held = docs.sparkSession.sparkContext.broadcast(rank)  # 2 ** RARITY_BITS numbers

    def batches(it):
        rank, seen = held.value, set()
        for b in slices(it):
            keys, texts, sizes, places = [], [], [], []
            for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if h in seen:
                    continue
                seen.add(h)
                x = ranked(shingles(t, width), rank)
                n = len(x)
                x = x[: n - int(np.ceil(similarity * n - 1e-9)) + 1]
                keys.append(x), texts.append(np.full(len(x), h, np.int64)), sizes.append(np.full(len(x), n, np.int32)), places.append(np.arange(len(x), dtype=np.int32))
            if keys:
                flat = [np.concatenate(c) for c in (keys, texts, sizes, places)]
                yield pa.RecordBatch.from_arrays([pa.array(flat[0].view(np.int64)), *map(pa.array, flat[1:])], names=["key", "text_hash", "n", "at"])

    rows = docs.select(F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    return rows.mapInArrow(batches, "key long, text_hash long, n int, at int")


def _bits(hashes: DataFrame) -> np.ndarray:
    """2 ** FILTER_BITS flags, set at the low bits of each value of a frame of one long column."""

    def add(it):
        flags = np.zeros(1 << FILTER_BITS, bool)
        for b in it:
            flags[b.column(0).to_numpy(zero_copy_only=False) & ((1 << FILTER_BITS) - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(flags).tobytes()])], names=["flags"])

    parts = hashes.repartition(TALLY_PARTS).mapInArrow(add, "flags binary").collect()  # TALLY_PARTS arrays, whatever the input
    none = np.zeros((1 << FILTER_BITS) // 8, np.uint8)  # an empty frame may have no part
    return np.unpackbits(np.bitwise_or.reduce([none, *(np.frombuffer(r.flags, np.uint8) for r in parts)])).astype(bool)


def sketch(h: np.ndarray) -> np.ndarray:
    """SKETCH words of bits: bit x mod 64 * SKETCH is the parity of the hashes x of a set that fall on it.

    Two sketches differ in no more bits than the sets in elements.
    """
    return np.packbits(np.bincount((h % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) % 2 == 1, bitorder="little").view(np.int64)


def shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int, whole: bool) -> DataFrame:
    """(text_hash, held) or (text_hash, sketch) of the texts of wanted (text_hash, rep), rep naming one row of docs for each.

    held: the sorted hashes of the set as bytes (whole). Flags of fixed size spare most other texts the shingling.
    """
    flags = docs.sparkSession.sparkContext.broadcast(_bits(wanted.select("text_hash")))  # 2 ** FILTER_BITS flags

    def batches(it):
        for b in it:
            maybe = flags.value[b.column(1).to_numpy(zero_copy_only=False) & ((1 << FILTER_BITS) - 1)]
            for part in slices([b.filter(pa.array(maybe))]):
                sets = [np.unique(shingles(t, width)) for t in part.column(2).to_pylist()]
                if whole:
                    found = pa.array([x.tobytes() for x in sets], pa.binary())
                else:
                    found = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * SKETCH), pa.array(np.concatenate([sketch(x) for x in sets])))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), found], names=["id", "h", "found"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).cast("string").alias("text"))
    rows = rows.mapInArrow(batches, "id long, h long, found " + ("binary" if whole else "array<long>"))
    rows = merged(rows, wanted, F.col("id").eqNullSafe(F.col("rep")) & (F.col("h") == F.col("text_hash")), "left_semi")
    return rows.select(F.col("h").alias("text_hash"), F.col("found").alias("held" if whole else "sketch")).dropDuplicates(["text_hash"])


def similar_links(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (a, b, u, v) of texts and their groups, distinct (u, v) with sets of at least this similarity."""

    def batches(it):
        for batch in slices(it):
            us, vs = [], []
            for u, v, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both and both >= similarity * (len(x) + len(y) - both) - 1e-9:
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    sets = sets.select("text_hash", "held")
    wide = merged(pairs, sets.withColumnsRenamed({"text_hash": "a", "held": "held_a"}), "a")
    wide = merged(wide, sets.withColumnsRenamed({"text_hash": "b", "held": "held_b"}), "b")
    return wide.select("u", "v", "held_a", "held_b").mapInArrow(batches, "u long, v long").distinct()


def complete(docs: DataFrame, rows: DataFrame, grouped: DataFrame, rank: np.ndarray, id_col: str, text_col: str, width: int, similarity: float) -> DataFrame:
    """grouped with groups united whose texts are at least this similar. Exact: no link at this similarity is lost.

    Candidates share one of their rarest shingles (prefix_keys) with as many shingles before it as the difference of the two may
    hold. First each text of a bucket meets STARS of its bucket only: the least of all, and such as the key chooses. That
    unites dense clusters at a cost linear in their size. Then every two texts of a bucket whose groups still differ meet, and only
    pairs whose sketches differ in no more bits than the sets may are held against each other whole.
    """
    share = (1 - similarity) / (1 + similarity)
    texts = merged(rows.groupBy("text_hash").agg(F.min("doc_id").alias("rep"), F.min("fp").alias("fp")), grouped.select("fp", "group"), "fp")
    texts = materialize(texts.select("text_hash", "rep", F.col("group").alias("base")), "simhash-by-text")
    label = texts.select("text_hash", "base", F.col("base").alias("group"))
    bucket = Window.partitionBy("key")

    def may(n, m, at, other):
        """Sizes and places at the first shared shingle allow the similarity."""
        n, m = F.col(n), F.col(m)
        return (n >= similarity * m - 1e-9) & (m >= similarity * n - 1e-9) & (F.col(at) + F.col(other) <= share * (n + m) + 1e-9)

    def mixed(cells, by):
        """The cells of buckets of several values of a column."""
        return cells.withColumns({"lo": F.min(by).over(bucket), "hi": F.max(by).over(bucket)}).where("lo <> hi").drop("lo", "hi")

    keys = mixed(prefix_keys(docs, rank, text_col, width, similarity), "text_hash").withColumn("before", F.min("at").over(bucket))
    keys = keys.where(F.col("at") + F.col("before") <= share * (1 + 1 / similarity) * F.col("n") + 1e-9).drop("before")  # may() with the least place and the largest size
    members = materialize(keys.distinct(), "simhash-members")
    here = materialize(mixed(merged(members, label.select("text_hash", "group"), "text_hash"), "group"), "simhash-mixed")
    discard(members)
    rep = texts.select("text_hash", "rep")
    sketches = materialize(shingle_sets(docs, merged(here.select("text_hash").distinct(), rep, "text_hash"), id_col, text_col, width, False), "simhash-sketches")
    words = lambda p: [F.col("sketch")[i].alias(f"{p}{i}") for i in range(SKETCH)]
    near = sum((F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"t{i}"))) for i in range(SKETCH)), F.lit(0)) <= share * (F.col("n") + F.col("m")) + 1e-9
    for k in range(2):
        if not k:
            orders = [F.lit(0) if not j else F.xxhash64("key", "text_hash", F.lit(j)) for j in range(STARS)]
            stars = [F.min(F.struct(order.alias("order"), "text_hash", "n", "at", "group")).over(bucket) for order in orders]
            star = here.withColumn("stars", F.array(*stars)).withColumn("c", F.explode("stars")).where("group <> c.group").select(F.col("text_hash").alias("a"), F.col("c.text_hash").alias("b"), F.col("group").alias("u"), F.col("c.group").alias("v"), "n", F.col("c.n").alias("m"), "at", F.col("c.at").alias("other"))
            star = star.where(may("n", "m", "at", "other")).select("a", "b", "u", "v", "n", "m").distinct()
            pairs = merged(star, sketches.select(F.col("text_hash").alias("a"), *words("s")), "a")
            pairs = merged(pairs, sketches.select(F.col("text_hash").alias("b"), *words("t")), "b").where(near)
        else:
            rest = mixed(merged(here.drop("group"), label.select("text_hash", "group"), "text_hash"), "group")
            rest = materialize(merged(rest, sketches.select("text_hash", *words("s")), "text_hash"), "simhash-rest")
            one = rest.withColumnsRenamed({"text_hash": "a", "group": "u"})
            two = rest.withColumnsRenamed({"text_hash": "b", "group": "v", "n": "m", "at": "other", "key": "key2"} | {f"s{i}": f"t{i}" for i in range(SKETCH)})
            pairs = merged(one, two, (one["key"] == two["key2"]) & (F.col("u") < F.col("v")) & may("n", "m", "at", "other") & near)
        pairs = materialize(pairs.select("a", "b", "u", "v").distinct(), f"simhash-pairs-{k}")
        if pairs.isEmpty():
            continue
        asked = pairs.select(F.col("a").alias("text_hash")).unionByName(pairs.select(F.col("b").alias("text_hash"))).distinct()
        sets = materialize(shingle_sets(docs, merged(asked, rep, "text_hash"), id_col, text_col, width, True), "simhash-sets")
        found = materialize(similar_links(pairs, sets, similarity), f"simhash-links-{k}")
        discard(sets)
        if found.isEmpty():
            continue
        wide = connected_components(found).withColumnsRenamed({"node": "group", "root": "wide"})
        label = materialize(merged(label, wide, "group", "left").select("text_hash", "base", F.coalesce("wide", "group").alias("group")), "simhash-labels")
    moved = label.select(F.col("base").alias("group"), F.col("group").alias("wide")).distinct()
    out = materialize(merged(grouped, moved, "group", "left").select("fp", "least", "rep", F.coalesce("wide", "group").alias("group")), "simhash-groups")
    for done in (here, sketches, rest):
        discard(done)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, taus: Sequence[int] = (4,), chain: int = 2, similarity: float | None = None) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id, rep_id, rep_hash) for each row of docs.

    Fingerprints within the last of taus are linked; smaller taus before it only connect what is dense, so
    that later ones look between components alone. component_id is the smallest doc_id reachable over links,
    itself included; equal fingerprints are linked. Null or empty texts have fingerprint 0 and form (or
    join) one component. Null doc_ids are members that never become component_id unless no other member has
    one (then it is null). similarity: texts whose sets of shingles are at least this similar (Jaccard) are linked
    too, since 64 bits cannot be searched at the distances of 0.8; see complete(). rep_id, rep_hash name the row that stands for
    the component: ties on doc_id go to the smaller text_hash. Repeated rows are repeated in the result. Other columns of docs
    are ignored, whatever their names.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, width, similarity is not None), "simhash")
    if similarity is not None:
        rank = rarity(rows.where("tally is not null"))
        rows = rows.where("tally is null").drop("tally")
    by_fp = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("rep")), "simhash-fp")
    close = connected_components(one_bit_links(by_fp.select("fp")))
    grouped = materialize(merged(by_fp, close.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "rep", F.coalesce("root", "fp").alias("group")), "simhash-groups")
    for tau in taus:
        far = links(grouped.select("fp", "group"), tau, tau + 1, chain)
        group_of = grouped.select("fp", "group")
        far = merged(far, group_of.withColumnsRenamed({"fp": "u", "group": "gu"}), "u")
        far = merged(far, group_of.withColumnsRenamed({"fp": "v", "group": "gv"}), "v").select(F.col("gu").alias("u"), F.col("gv").alias("v"))
        wide = connected_components(far).withColumnRenamed("node", "group")
        grouped = materialize(merged(grouped, wide, "group", "left").select("fp", "least", "rep", F.coalesce("root", "group").alias("group")), "simhash-groups")
    if similarity is not None:
        grouped = complete(docs, rows, grouped, rank, id_col, text_col, width, similarity)
    best = grouped.groupBy("group").agg(F.min("least").alias("component_id"), F.min("rep").alias("rep"))
    named = merged(grouped.select("fp", "group"), best, "group").select("fp", F.col("group").alias("root"), "component_id", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash"))
    return merged(rows, materialize(named, "simhash-named"), "fp").select("doc_id", "text_hash", "fp", "root", "component_id", "rep_id", "rep_hash")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs without near-duplicates: one row of each component stays, all columns as they are, whatever their names.

    Of rows that repeat the chosen doc_id and text, one stays. Null and empty texts are one component, of which one stays; a row
    without doc_id stays only where its whole component has none. An empty table stays empty.
    """
    own, id_at, text_at = veiled(docs, id_col, text_col)
    chosen = near_duplicates(own, id_at, text_at, **how)
    chosen = chosen.where(F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("text_hash") == F.col("rep_hash"))).select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash")).distinct()
    marked = own.withColumn("hash", F.xxhash64(text_at))
    kept = merged(marked, chosen, F.col(id_at).cast("long").eqNullSafe(F.col("kept_id")) & (F.col("hash") == F.col("kept_hash")), "left_semi")
    first = Window.partitionBy(F.col(id_at).cast("long"), "hash").orderBy("hash")
    return unveiled(kept.withColumn("nth", F.row_number().over(first)).where("nth = 1"), docs)


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """Query op2: documents with 4-word shingles, links at 4 or fewer differing bits."""
    out = near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
