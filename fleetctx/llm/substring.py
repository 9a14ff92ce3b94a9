"""Suffix-array dedup: bytes covered by a string of `length` bytes that also starts elsewhere are removed.

Every start of such a string has one anchor, the leftmost least hash among the `gram`-byte strings in it. Equal
strings have equal anchors at equal offsets, so starts are sharded by anchor and no match crosses shards:
1. anchors: (hash, first start, number of starts) of every document; hashes found once cannot repeat;
2. a repeated anchor's segment is the text of its starts; equal segments become one with a multiplicity;
3. a shard's different segments get a suffix array by induced sorting and permuted common prefixes; starts
   whose common prefixes reach `length` fall into classes, and a class of two places repeats;
4. places go back to their documents, and covered bytes are cut.
An anchor with very many different segments is cut into pieces of a few starts, sharded by anchor, piece and
the bytes common to the piece's strings, so that copies of one passage meet as equal pieces and not in one task.
Where even such a key has very many different pieces (the edges of a passage in very many surroundings), their single
starts are counted by 128-bit hashes, which no key gathers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, documents, materialize, with_document
from .suffix import permuted_lcp, suffix_array, words_at

LENGTH, GRAM = 400, 64
BLOCK = 1 << 19
#: Bytes of different segments in one shard, about; and from which one anchor's segments are cut into pieces.
SHARD_BYTES = 2 << 20
PIECE = 16


def gram_hashes(t: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of every `gram` bytes (a power of two, 8 at least) of t."""
    h, k = words_at(t)[: max(0, len(t) - 7)], 8
    one, two = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    h = h * one
    h ^= h >> np.uint64(29)
    while k < gram:
        h = (h[:-k] if len(h) > k else h[:0]) * one ^ (h[k:] * two)
        h ^= h >> np.uint64(32)
        k *= 2
    return h


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, anchor, first start, number of starts) of each run of starts with one anchor."""
    starts = len(text) - length + 1
    none = np.zeros(0, np.int64)
    if starts < 1:
        return none.astype(np.uint64), none, none, none
    h, width = gram_hashes(np.frombuffer(text, np.uint8), gram), length - gram + 1
    out = []
    for c in range(0, starts, BLOCK):
        n = min(BLOCK, starts - c)
        part = (h[c : c + n + width - 1] & ~np.uint64(0xFFFFF)) | np.arange(n + width - 1, dtype=np.uint64)  # the place breaks ties
        padded = np.full(-(-len(part) // width) * width, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(part)] = part
        rows = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = (np.minimum(back[:n], ahead[width - 1 : width - 1 + n]) & np.uint64(0xFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.diff(least, prepend=-1))
        out.append((least[first] + c, first + c, np.diff(np.append(first, n))))
    anchor, first, count = (np.concatenate(x) for x in zip(*out))
    return h[anchor], anchor, first, count


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("th"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def find_anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, th, h, anchor, first, n) of every row of docs (doc_id, th, text)."""

    def scan(it):
        for b in it:
            texts = b.column(2)
            found = [anchors(_bytes(texts[k].as_py()), length, gram) for k in range(len(texts))]
            if not found:
                continue
            of = pa.array(np.repeat(np.arange(len(found)), [len(x[0]) for x in found]))
            h, anchor, first, n = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), pa.array(h.view(np.int64)), pa.array(anchor.astype(np.int64)), pa.array(first.astype(np.int64)), pa.array(n.astype(np.int64))], names=["doc_id", "th", "h", "anchor", "first", "n"])

    return docs.mapInArrow(scan, "doc_id long, th long, h long, anchor long, first long, n long")


SEGMENT = [("doc_id", pa.int64()), ("th", pa.int64()), ("first", pa.int64()), ("seg", pa.binary()), ("h", pa.int64()), ("back", pa.int64()), ("n", pa.int64()), ("body", pa.binary())]


def cut_segments(docs: DataFrame, length: int) -> DataFrame:
    """docs (doc_id, th, text, spots) -> a row for each segment: its place, its key, its anchor, its bytes."""

    def cut(it):
        for b in it:
            rows = []
            for doc_id, th, text, spots in zip(*(c.to_pylist() for c in b.columns)):
                raw = _bytes(text)
                for x in spots:
                    first, n, back = x["first"], x["n"], x["anchor"] - x["first"]
                    body = raw[first : first + n + length - 1]
                    seg = xxhash.xxh3_128_digest(body + b"%d %d" % (n, back))
                    rows.append((doc_id, th, first, seg, x["h"], back, n, body))
                if len(rows) > 5000:
                    yield _batch(rows, SEGMENT)
                    rows = []
            yield _batch(rows, SEGMENT)

    return docs.mapInArrow(cut, "doc_id long, th long, first long, seg binary, h long, back long, n long, body binary")


def repeated_starts(bodies: list[bytes], own: np.ndarray, times: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """For each body, the runs [from, to) of its first `own` starts whose string occurs twice or more among all own starts."""
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies)) + 1
    begin = np.cumsum(sizes) - sizes
    t = np.frombuffer(b"\xff".join(bodies) + b"\xff", np.uint8)  # UTF-8 has no 0xFF
    sa = suffix_array(t)
    weight = np.zeros(len(t), np.int64)
    first = np.repeat(begin, own)
    starts = first + np.arange(len(first)) - np.repeat(np.cumsum(own) - own, own)
    weight[starts] = np.repeat(times, own)
    kind = np.cumsum(permuted_lcp(t, sa)[sa] < length)
    total = np.bincount(kind, weight[sa])
    hit = np.zeros(len(t) + 1, np.int8)
    hit[sa] = total[kind] >= 2
    out = []
    for a, n in zip(begin.tolist(), own.tolist()):
        edge = np.flatnonzero(np.diff(hit[a : a + n], prepend=0, append=0))
        out.append(list(zip(edge[::2].tolist(), edge[1::2].tolist())))
    return out


RUNS = "seg binary, runs array<struct<a: long, z: long>>"


def _match(segments: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """Different segments (seg, h, n, times, body) -> (seg, runs) of those that have repeated starts."""
    size = segments.agg(F.sum(F.length("body"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))

    def induce(g: pd.DataFrame) -> pd.DataFrame:
        runs = repeated_starts(list(map(bytes, g["body"])), g["n"].to_numpy(), g["times"].to_numpy(), length)
        kept = [(s, [{"a": a, "z": z} for a, z in r]) for s, r in zip(g["seg"], runs) if r]
        return pd.DataFrame(kept, columns=["seg", "runs"])

    return segments.groupBy(F.pmod(F.xxhash64("h"), F.lit(shards)).alias("shard")).applyInPandas(induce, RUNS)


def _pieces(segments: DataFrame, length: int, piece: int) -> DataFrame:
    """Segments cut into at most `piece` starts, (h, seg, n, times, body, parent, at): h is now anchor, piece and common bytes."""

    def cut(it):
        for g in it:
            rows = []
            for seg, h, back, n, times, body in zip(g["seg"], g["h"], g["back"], g["n"], g["times"], g["body"]):
                body = bytes(body)
                ends = sorted({n, *(e for e in range(n) if (back - e) % piece == piece - 1)} - {0})  # by distance from the anchor
                at = 0
                for e in ends:
                    part = body[at : e + length - 1]
                    low = (back - at) // piece * piece
                    core = body[back - low : back - low - piece + 1 + length]  # in every string of the piece
                    key = xxhash.xxh64_intdigest(core + b"%d %d" % (h, low)) - (1 << 63)
                    rows.append((key, xxhash.xxh3_128_digest(part + b"%d %d %d" % (e - at, back - at, h)), e - at, times, part, bytes(seg), at))
                    at = e
            yield pd.DataFrame(rows, columns=["h", "seg", "n", "times", "body", "parent", "at"])

    return segments.select("seg", "h", "back", "n", "times", "body").mapInPandas(cut, "h long, seg binary, n long, times long, body binary, parent binary, at long")


def _starts(pieces: DataFrame, length: int) -> DataFrame:
    """Of pieces (seg, h, n, times, body), runs of the starts whose string occurs twice or more, by the strings' hashes."""

    def hashes(it):
        for b in it:
            rows = []
            for seg, h, n, times, body in zip(*(c.to_pylist() for c in b.columns)):
                rows += [(seg, k, times, xxhash.xxh3_128_digest(body[k : k + length] + b"%d" % h)) for k in range(n)]
            yield _batch(rows, [("seg", pa.binary()), ("k", pa.int64()), ("times", pa.int64()), ("s", pa.binary())])

    each = pieces.select("seg", "h", "n", "times", "body").mapInArrow(hashes, "seg binary, k long, times long, s binary")
    each = materialize(each, "starts")
    twice = materialize(each.groupBy("s").agg(F.sum("times").alias("found")).where("found > 1").select("s"), "repeated-starts")
    return each.join(twice, "s").groupBy("seg").agg(F.collect_list(F.struct(F.col("k").alias("a"), (F.col("k") + 1).alias("z"))).alias("runs"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, th, spans): for each document that has any, its repeated starts as runs [a, z) of byte offsets.

    Rows that share doc_id and text are different places with the same result. Null and empty texts repeat nothing; an empty table
    gives no row.
    """
    rows = _rows(docs, id_col, text_col)
    found = materialize(find_anchors(rows, length, gram), "anchors")
    twice = materialize(found.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h"), "repeated-anchors")  # written, so that a hot anchor's join can be split
    spots = found.join(twice, "h").groupBy("doc_id", "th").agg(F.collect_set(F.struct("h", "anchor", "first", "n")).alias("spots"))
    places = materialize(cut_segments(with_document(rows, spots).select("doc_id", "th", "text", "spots"), length), "segments")
    discard(found), discard(twice)
    distinct = places.groupBy("seg").agg(F.count(F.lit(1)).alias("times"), F.first("h").alias("h"), F.first("back").alias("back"), F.first("n").alias("n"), F.first("body").alias("body"))
    distinct = materialize(distinct, "different-segments")

    def kinds(segments, label):
        """(h, held) of the keys of several different segments."""
        return materialize(segments.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.length("body")).alias("held")).where("kinds > 1").select("h", "held"), label)

    def back(cut, runs):
        """Runs of the segments that were cut, from those of their pieces."""
        moved = cut.select("seg", "parent", "at").join(runs, "seg").select(F.col("parent").alias("seg"), F.transform("runs", lambda r: F.struct((r["a"] + F.col("at")).alias("a"), (r["z"] + F.col("at")).alias("z"))).alias("runs"))
        return moved.groupBy("seg").agg(F.flatten(F.collect_list("runs")).alias("runs"))

    every = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n").alias("z")))
    several = kinds(distinct, "anchor-kinds")
    mixed = distinct.join(several, "h")
    runs = _match(mixed.where(F.col("held") <= shard_bytes), length, shard_bytes)
    if not several.where(F.col("held") > shard_bytes).isEmpty():
        cut = materialize(_pieces(mixed.where(F.col("held") > shard_bytes), length, PIECE), "pieces")
        part = cut.groupBy("seg").agg(F.sum("times").alias("times"), F.first("h").alias("h"), F.first("n").alias("n"), F.first("body").alias("body"))
        part = materialize(part, "different-pieces")
        met = part.join(kinds(part, "piece-kinds"), "h")
        pieces = _match(met.where(F.col("held") <= shard_bytes), length, shard_bytes).unionByName(part.where("times > 1").select("seg", every.alias("runs")))
        hot = met.where(F.col("held") > shard_bytes)
        if not hot.isEmpty():
            pieces = pieces.unionByName(_starts(hot, length))
        runs = runs.unionByName(back(cut, pieces))
    whole = distinct.where("times > 1").select("seg", every.alias("runs"))
    # A segment found twice repeats as a whole; it is among the runs as well where its anchor has others.
    hit = materialize(whole.unionByName(runs.join(whole.select("seg"), "seg", "left_anti")), "repeated-runs")
    discard(distinct)
    spans = places.select("seg", "doc_id", "th", "first").join(hit, "seg")
    spans = spans.select("doc_id", "th", F.transform("runs", lambda r: F.struct((r["a"] + F.col("first")).alias("a"), (r["z"] + F.col("first")).alias("z"))).alias("runs"))
    return spans.groupBy("doc_id", "th").agg(F.array_distinct(F.flatten(F.collect_list("runs"))).alias("spans"))


def covered(spans, length: int, size: int) -> list[list[int]]:
    """Maximal runs of bytes covered by strings of `length` that start in the spans."""
    out: list[list[int]] = []
    for a, z in sorted((x["a"], x["z"]) for x in spans or ()):
        z = min(size, z - 1 + length)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for each row of docs; kept: the remaining bytes.

    A null text is empty. Repeated rows are copies of each other: of at least `length` bytes, all go. Texts
    below `length` bytes lose nothing. Extra columns are ignored.
    """
    found = materialize(repeats(docs, id_col, text_col, length, gram, shard_bytes), "spans")

    def cut(it):
        for b in it:
            rows = []
            for doc_id, text, spans in zip(*(c.to_pylist() for c in b.columns)):
                raw = _bytes(text)
                gone = covered(spans, length, len(raw))
                at, kept = 0, []
                for a, z in gone:
                    kept.append(raw[at:a])
                    at = z
                rows.append((doc_id, len(raw), sum(z - a for a, z in gone), len(gone), b"".join([*kept, raw[at:]])))
            yield _batch(rows, [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    rows = with_document(_rows(docs, id_col, text_col), found, "left")
    return rows.select("doc_id", "text", "spans").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op5_suffix(spark, sf_dir: str) -> DataFrame:
    """Query op5: documents, strings of 400 bytes."""
    return dedup(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
