"""Token ids in ORC: tokenizers ids of whole texts, in ascending doc_id order, read back by stripes.

ORC keeps the ids with integer run-length encoding, a row index for every 1000 rows and a Bloom filter on
doc_id, so a reader of a few documents skips stripes by metadata, and readers split files by stripe.

The tokenizer's byte-level BPE never joins across its pre-tokens, and a space always opens one, so a text
without runs of white space around a space is encoded piece by piece (' word'), each distinct piece once. A piece
that ends in marks or holds line ends is put together from pieces without them ('word.' and 'word,' share ' word').
Other texts go to the library whole, and so do those that hold one of the tokenizer's added tokens, which the library finds first.
"""

from __future__ import annotations

import sys
import types
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import documents, new_path

END_ID = 0
#: Pieces that one worker remembers; when full it starts anew.
MEMORY = 900_000
#: New pieces go to the library so many at a time: it is slower on longer texts.
LINE = 32
#: Texts of about so many characters are taken together, and their different pieces looked up once.
KNOWN = 4_000_000
#: Marks that end a pre-token of letters or digits before them.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class Encoder:
    """Encodes texts with a tokenizers model, remembering the ids of pieces."""

    def __init__(self, model_json: str, memory: int = MEMORY):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model_json)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # ids of tokens that begin with a space
        self.opens[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True
        self.newline = vocabulary["\u010a"]
        self.memory = memory
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.first = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int64)
        self.edges = np.zeros((2, 1 << 16), bool)  # the piece begins, ends with white space
        self.flat = np.zeros(1 << 18, np.int32)
        self.used = 0

    def _batch(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of printable pieces in one array, and the number of each piece's ids; all of them open a text, or none does."""
        opening = names[0][0] == "\0"
        if opening:
            lines = ["\n".join([p[1:] for p in names[k : k + LINE]] + [""]) for k in range(0, len(names), LINE)]
        else:
            lines = ["".join([" " + p for p in names[k : k + LINE]]) for k in range(0, len(names), LINE)]
        flat = np.array([i for ids in self._batch(lines) for i in ids], np.int32)
        if opening:
            ends = np.flatnonzero(flat == self.newline)
            if len(ends) == len(names):
                return flat[flat != self.newline], np.diff(ends, prepend=-1) - 1
        else:
            starts = np.flatnonzero(self.opens[flat])
            if len(starts) == len(names):
                return flat, np.diff(np.append(starts, len(flat)))
        return self._each(names)

    def _each(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = self._batch([p[1:] if p[:1] == "\0" else " " + p for p in names])
        return np.array([i for ids in each for i in ids], np.int32), np.fromiter(map(len, each), np.int64, len(each))

    @staticmethod
    def _gather(flat: np.ndarray, first: np.ndarray, size: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces in a row, and where each piece's end."""
        sizes = size[index]
        stops = np.cumsum(sizes)
        return flat[np.repeat(first[index] - (stops - sizes), sizes) + np.arange(int(stops[-1]) if len(stops) else 0)], stops

    def _keep(self, names: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.at)
        while n + len(names) > len(self.first):
            self.first, self.size, self.edges = np.resize(self.first, 2 * len(self.first)), np.resize(self.size, 2 * len(self.size)), np.concatenate([self.edges, np.zeros_like(self.edges)], axis=1)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.first[n : n + len(names)] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + len(names)] = sizes
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.at.update(zip(names, range(n, n + len(names))))

    def _find(self, names: list[str]) -> np.ndarray:
        """Places of different pieces, learned where they are new; a name is a piece without its space, or NUL and one that has none."""
        index = np.fromiter(map(self.at.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(index < 0).tolist()
        if not new:
            return index
        inner, opening, others = [], [], []  # white space beside the space is not printable
        for k in new:
            p = names[k]
            if p[:1] == "\0":
                (opening if len(p) > 1 and p[1:].isprintable() else others).append(p)
            else:
                (inner if p and p.isprintable() else others).append(p)
        for some in inner, opening:
            if some:
                self._keep(some, *self._ids(some))
        n = len(self.at)
        self._keep(others, *self._each(others))
        for k, p in enumerate(others, n):
            bare = p[1:] if p[:1] == "\0" else p or " "
            self.edges[:, k] = bare[:1].isspace(), bare[-1:].isspace()
        index[new] = np.fromiter((self.at[names[k]] for k in new), np.int64, len(new))
        return index

    def _places(self, pieces: pa.Array, opening: np.ndarray) -> np.ndarray:
        """Places of pieces, which open a text or follow a space."""
        place = np.zeros(len(pieces), np.int64)
        for flag in False, True:
            which = np.flatnonzero(opening == flag)
            if len(which):
                coded = pieces.take(pa.array(which)).dictionary_encode()
                names = strings(coded.dictionary)
                place[which] = self._find(["\0" + p for p in names] if flag else names)[coded.indices.to_numpy()]
        return place

    def _assemble(self, pieces: pa.Array, opening: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids of different pieces in one array, where each one's begin, their numbers, and whether it begins, ends with white space.

        Pre-tokens end before and after a line end between printable characters, and before marks behind a letter or digit, so a
        piece's ids are those of its lines without the marks, of the marks, and of the line ends. A line of marks alone stays
        whole, since a space joins it.
        """
        lined = pc.match_substring(pieces, "\n").to_numpy(zero_copy_only=False).copy()
        held = pieces.filter(pa.array(lined))
        apart = pc.utf8_is_printable(pc.replace_substring(held, "\n", ""))
        for x in pc.match_substring(held, "\n\n"), pc.starts_with(held, "\n"), pc.ends_with(held, "\n"):
            apart = pc.and_not(apart, x)
        lined[lined] = apart.to_numpy(zero_copy_only=False)
        order = np.concatenate([np.flatnonzero(~lined), np.flatnonzero(lined)])
        lists = pc.split_pattern(pieces.filter(pa.array(lined)), "\n")
        lines = pa.concat_arrays([pieces.filter(pa.array(~lined)), lists.flatten()])
        counts = np.concatenate([np.ones(len(pieces) - len(lists), np.int64), np.diff(lists.offsets.to_numpy())])
        last = np.cumsum(counts) - 1
        opens = np.ones(len(lines), bool)
        opens[last - counts + 1] = opening[order]

        trimmed = pc.ascii_rtrim(lines, MARKS)
        end = pc.utf8_slice_codeunits(trimmed, -1).dictionary_encode()
        known = np.array([c < "\u0250" and c.isalnum() for c in strings(end.dictionary)], bool)
        marked = known[end.indices.to_numpy()] & pc.not_equal(pc.binary_length(lines), pc.binary_length(trimmed)).to_numpy(zero_copy_only=False)
        nothing, newline = self._find(["\0", "\0\n"])
        units = np.full((len(lines), 3), nothing)
        units[:, 0] = self._places(pc.if_else(pa.array(marked), trimmed, lines), opens)
        mask = pa.array(marked)
        tails = ["\0" + p[k:] for p, k in zip(strings(lines.filter(mask)), pc.utf8_length(trimmed.filter(mask)).to_numpy().tolist())]
        names = list(dict.fromkeys(tails))
        place = dict(zip(names, self._find(names).tolist()))
        units[marked, 1] = np.fromiter(map(place.__getitem__, tails), np.int64, len(tails))
        units[:, 2] = newline
        units[last, 2] = nothing
        flat, stops = self._gather(self.flat, self.first, self.size, units.ravel())
        stops = stops[2::3][last]
        first, size, edges = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64), np.zeros((2, len(pieces)), bool)
        size[order] = np.diff(stops, prepend=0)
        first[order] = stops - size[order]
        edges[:, order] = self.edges[0, units[last - counts + 1, 0]], self.edges[1, units[last, 0]] & ~marked[last]
        return flat, first, size, edges

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """The ids of each text, without the end id."""
        if len(self.at) > self.memory:
            self.clear()
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        apart = np.zeros(len(texts), bool)
        for x in ["\0", *self.added]:
            apart |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        whole = set(np.flatnonzero(apart).tolist())
        lists = pc.split_pattern(pc.if_else(pa.array(apart), pa.scalar("", texts.type), texts) if whole else texts, " ")
        pieces = lists.flatten().dictionary_encode()
        bounds, codes = lists.offsets.to_numpy(), pieces.indices.to_numpy().copy()
        opening = np.zeros(len(codes), bool)  # pieces without a space before them: the first of each text
        opening[bounds[:-1]] = True
        heads, which = np.unique(codes[opening], return_inverse=True)
        needed = np.zeros(len(pieces.dictionary), bool)
        needed[codes[~opening]] = True
        codes = (np.cumsum(needed) - 1)[codes]
        codes[opening] = which + needed.sum()
        different = pa.concat_arrays([pieces.dictionary.filter(pa.array(needed)), pieces.dictionary.take(pa.array(heads))])
        flat, first, size, edges = self._assemble(different, np.arange(len(different)) >= needed.sum())
        # White space on both sides of a space may join in one pre-token: such a text is encoded whole.
        joined = edges[1, codes[:-1]] & edges[0, codes[1:]] & ~opening[1:]
        whole |= set((np.searchsorted(bounds, np.flatnonzero(joined), "right") - 1).tolist())
        found: list[np.ndarray] = []
        for i, j in spans(np.diff(bounds).tolist(), 300_000):
            ids, stops = self._gather(flat, first, size, codes[bounds[i] : bounds[j]])
            at = np.concatenate([[0], stops])[bounds[i : j + 1] - bounds[i]]
            found += [ids[a:z] for a, z in zip(at[:-1], at[1:])]
        for k in whole:
            found[k] = np.array(self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, np.int32)
        return found


def _encoder(key: str, model_json: str) -> Encoder:
    """One encoder for a Python worker, whatever tasks it runs."""
    held = sys.modules.setdefault("_fleetctx_held", types.ModuleType("_fleetctx_held"))
    if key not in held.__dict__:
        held.__dict__[key] = Encoder(model_json)
    return held.__dict__[key]


def strings(array: pa.Array) -> list[str]:
    """What to_pylist gives, in half the time or less."""
    return array.to_numpy(zero_copy_only=False).tolist()


def blocks(texts: list[str], most: int = 2_000_000):
    """Slices of texts of about `most` characters; a longer text is a slice of its own."""
    return spans(map(len, texts), most)


def spans(lengths, most: int = 2_000_000):
    """The slices of blocks, from the texts' lengths."""
    start = size = end = 0
    for k, n in enumerate(lengths):
        if size and size + n > most:
            yield start, k
            start, size = k, 0
        size += n
        end = k + 1
    if start < end:
        yield start, end


def write_ids(docs: DataFrame, path: str, model_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, stripe_bytes: int = 16 << 20) -> None:
    """Write (doc_id, ids, part, part_start) as ORC at path, rows in ascending doc_id order.

    part: number of the file in that order; part_start: ids before the row in its file. A null or empty text has the
    end id alone; null doc_ids come first; rows that share a doc_id follow in the order of their texts' hashes, then texts, so
    that repeated rows stay next to each other. An empty table gives files without rows. Other columns are ignored.
    """
    with open(model_path, encoding="utf-8") as f:
        model_json = f.read()
    key = f"tokens-{zlib.crc32(model_json.encode())}"

    def encode(it):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, part, at = _encoder(key, model_json), TaskContext.get().partitionId(), 0
        for b in it:
            texts = pc.fill_null(b.column(1), "")
            lengths = pc.utf8_length(texts).to_numpy().tolist()
            for begin, end in spans(lengths, KNOWN):
                encoded = encoder.encode(texts.slice(begin, end - begin))
                for i, j in spans(lengths[begin:end]):
                    found = encoded[i:j]
                    sizes = np.fromiter(map(len, found), np.int64, j - i) + 1
                    ends = np.cumsum(sizes)
                    flat = np.full(int(ends[-1]), end_id, np.int32)
                    keep = np.ones(len(flat), bool)
                    keep[ends - 1] = False
                    flat[keep] = np.concatenate(found)
                    offsets = np.concatenate([[0], ends]).astype(np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                    starts = at + offsets[:-1].astype(np.int64)
                    at += int(ends[-1])
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(begin + i, j - i), ids, pa.array(np.full(j - i, part, np.int32)), pa.array(starts)], names=["doc_id", "ids", "part", "part_start"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("th"))
    ordered = rows.repartitionByRange("doc_id", "th").sortWithinPartitions("doc_id", "th", "text")
    out = ordered.mapInArrow(encode, "doc_id long, ids array<int>, part int, part_start long")
    out.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.row.index.stride", "1000").option("orc.stripe.size", str(stripe_bytes)).orc(path)


def read_ids(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, ids, part, part_start) from the files; doc_ids reach the stripes' Bloom filters."""
    rows = spark.read.schema("doc_id long, ids array<int>, part int, part_start long").orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files."""

    def check(it):
        for b in it:
            ids = b.column(1)
            offsets, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crcs = [zlib.crc32(memoryview(flat[a:z])) for a, z in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crcs, pa.int64())], names=["doc_id", "part", "part_start", "n_tokens", "ids_crc32"])

    rows = read_ids(spark, path).mapInArrow(check, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long")
    totals = read_ids(spark, path).groupBy("part").agg(F.sum(F.size("ids")).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    offsets = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return rows.join(offsets, "part").select("doc_id", (F.col("offset") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")


def op7_orc(spark, sf_dir: str) -> DataFrame:
    """Query op7: documents with byte_bpe_50k.json, written in the shared folder and read back."""
    import public_tokenizers

    path = new_path(spark, "token-orc")
    write_ids(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    return digest(spark, path)
