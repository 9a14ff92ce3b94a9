"""Line dedup that can be undone: exact reference counts of line keys, and sharded cuckoo filters over them.

The counts say in how many documents a key is found; documents can be added and deleted, and a key whose
count falls to zero is forgotten. A shard's cuckoo filter holds the keys whose count has reached the
threshold; keys that cross it are inserted into or deleted from their filter. Filters that are small together
go to every task; larger ones are met shard by shard, by lines that are dealt by shard and salt. Lines that pass one are
then held against the exact counts, so a false positive drops nothing. A table of the documents' hashes and
their counts lets a deletion refuse documents that are not there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import WS, documents, lowered, materialize, with_document

SLOTS = 4
KICKS = 500
#: Keys of a shard's filter, about, and least shards; salts that deal a shard's lines over tasks.
SHARD_KEYS, SHARDS, SALTS = 200_000, 64, 16
#: Filters of more bytes than this together are not sent to every task: lines are dealt to them by shard.
BROADCAST_FILTERS = 64 << 20


class Cuckoo:
    """A cuckoo filter of 16-byte keys: buckets of four 16-bit fingerprints."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def of(cls, keys: list[bytes]) -> Cuckoo:
        size = 1 << max(1, int(np.ceil(np.log2(max(1, len(keys)) / SLOTS / 0.8 + 1))))
        while True:
            made = cls(np.zeros((size, SLOTS), np.uint16))
            if all(map(made.insert, keys)):
                return made
            size *= 2

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """keys: (n, 16) bytes -> fingerprint and both buckets of each."""
        mark = np.maximum(keys[:, 8:10].copy().view(np.uint16)[:, 0], 1)
        one = keys[:, :8].copy().view(np.uint64)[:, 0] & np.uint64(len(self.table) - 1)
        return mark, one, self._other(one, mark)

    def _other(self, bucket, mark):
        return bucket ^ ((mark.astype(np.uint64) * np.uint64(0x5BD1E995)) & np.uint64(len(self.table) - 1))

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(keys)
        return ((self.table[one] == mark[:, None]) | (self.table[two] == mark[:, None])).any(axis=1)

    def insert(self, key: bytes) -> bool:
        """False if the filter is too full; it must then be built anew from the counts."""
        (mark,), (one,), (two,) = self._places(np.frombuffer(key, np.uint8).reshape(1, 16))
        for bucket in (one, two):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
        bucket = two
        for k in range(KICKS):
            slot = k % SLOTS
            mark, self.table[bucket, slot] = self.table[bucket, slot], mark
            bucket = self._other(bucket, mark)
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
        return False

    def delete(self, key: bytes) -> bool:
        """Take one fingerprint of a key that was inserted."""
        (mark,), (one,), (two,) = self._places(np.frombuffer(key, np.uint8).reshape(1, 16))
        for bucket in (one, two):
            held = np.flatnonzero(self.table[bucket] == mark)
            if len(held):
                self.table[bucket, held[0]] = 0
                return True
        return False


def line_key(line: Column, least: int = 1) -> Column:
    """MD5 of the line without ASCII white space at its ends and with A-Z lowered; null below `least` code points."""
    key = lowered(F.btrim(line, F.lit(WS)))
    return F.when(F.length(key) >= least, F.unhex(F.md5(key.cast("binary"))))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def _pack(shard: int, made: Cuckoo) -> pd.DataFrame:
    return pd.DataFrame({"shard": [shard], "table": [made.table.tobytes()]})


def _hold(table: bytes) -> Cuckoo:
    return Cuckoo(np.frombuffer(table, np.uint16).reshape(-1, SLOTS).copy())


def _keys(column: pa.Array) -> np.ndarray:
    """16-byte keys of an Arrow column without nulls, as (n, 16) bytes."""
    start = column.offset
    first = np.frombuffer(column.buffers()[1], np.int32)[start] if len(column) else 0
    return np.frombuffer(column.buffers()[2], np.uint8)[first : first + 16 * len(column)].reshape(-1, 16)


FILTER_SCHEMA = "shard int, table binary"


class LineIndex:
    """Counts (key, n_docs), filters (shard, table) and documents (th, n), all in the shared folder; every change makes a new index."""

    def __init__(self, counts: DataFrame, filters: DataFrame, held: DataFrame, least: int, min_docs: int, shards: int):
        self.counts, self.filters, self.held, self.least, self.min_docs, self.shards = counts, filters, held, least, min_docs, shards

    @classmethod
    def build(cls, docs: DataFrame, text_col: str = "text", least: int = 1, min_docs: int = 10, shards: int | None = None) -> LineIndex:
        """An index of all rows of docs; each row is a document, repeated ones too. Null and empty texts are one empty line.

        shards: as many as the keys of min_docs or more documents need, where not given. An empty table makes an empty index.
        """
        counts = materialize(cls._count(docs, text_col, least), "line-counts")
        hot = counts.where(F.col("n_docs") >= min_docs)
        shards = shards or max(SHARDS, -(-hot.count() // SHARD_KEYS))
        keyed = hot.select(_shard(F.col("key"), shards).alias("shard"), "key")
        made = keyed.groupBy("shard").applyInPandas(lambda g: _pack(int(g["shard"].iloc[0]), Cuckoo.of(list(map(bytes, g["key"])))), FILTER_SCHEMA)
        return cls(counts, materialize(made, "line-filters"), cls._documents(docs, text_col), least, min_docs, shards)

    @staticmethod
    def _documents(docs: DataFrame, text_col: str) -> DataFrame:
        return docs.groupBy(F.xxhash64(F.col(text_col).cast("string")).alias("th")).agg(F.count(F.lit(1)).alias("n"))

    @staticmethod
    def _count(docs: DataFrame, text_col: str, least: int) -> DataFrame:
        keys = docs.select(F.explode(F.array_distinct(F.transform(_lines(F.col(text_col)), lambda x: line_key(x, least)))).alias("key"))
        return keys.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"))

    def insert(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        """With the rows of docs as further documents; none leaves the index as it is."""
        return self._change(docs, text_col, 1)

    def delete(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        """Without the rows of docs. Raises ValueError, and changes nothing, if a text is not in the index as often as it is to go."""
        return self._change(docs, text_col, -1)

    def _change(self, docs: DataFrame, text_col: str, sign: int) -> LineIndex:
        more = self._documents(docs, text_col).select("th", (F.col("n") * sign).alias("n"))
        held = materialize(self.held.unionByName(more).groupBy("th").agg(F.sum("n").alias("n")), "line-documents")
        if sign < 0 and not (short := held.where("n < 0")).isEmpty():
            raise ValueError(f"{short.count()} texts are to be deleted more often than they were inserted")
        delta = self._count(docs, text_col, self.least).select("key", F.lit(0).cast("long").alias("old"), (F.col("n_docs") * sign).alias("d"))
        both = self.counts.select("key", F.col("n_docs").alias("old"), F.lit(0).cast("long").alias("d")).unionByName(delta)
        both = materialize(both.groupBy("key").agg(F.sum("old").alias("old"), (F.sum("old") + F.sum("d")).alias("n_docs")), "line-counts")
        was, now = F.col("old") >= self.min_docs, F.col("n_docs") >= self.min_docs
        keyed = both.select(_shard(F.col("key"), self.shards).alias("shard"), "key", was.alias("was"), now.alias("now")).where("was or now")
        changes, filters = keyed.where("was <> now").groupBy("shard"), self.filters.groupBy("shard")

        def update(key, change: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
            if not len(change):
                return before[["shard", "table"]]
            made = _hold(before["table"].iloc[0]) if len(before) else Cuckoo.of([])
            for k, into in zip(change["key"], change["now"]):
                if not (made.insert if into else made.delete)(bytes(k)):
                    return pd.DataFrame({"shard": [int(key[0])], "table": [b""]})  # full
            return _pack(int(key[0]), made)

        made = materialize(changes.cogroup(filters).applyInPandas(update, FILTER_SCHEMA), "line-filters")
        full = made.where(F.length("table") == 0)
        if not full.isEmpty():
            again = keyed.where("now").join(full.select("shard"), "shard").select("shard", "key").groupBy("shard")
            anew = again.applyInPandas(lambda g: _pack(int(g["shard"].iloc[0]), Cuckoo.of(list(map(bytes, g["key"])))), FILTER_SCHEMA)
            made = materialize(made.where(F.length("table") > 0).unionByName(anew), "line-filters")
        return LineIndex(both.where("n_docs > 0").select("key", "n_docs"), made, held.where("n > 0"), self.least, self.min_docs, self.shards)

    def passing(self, lines: DataFrame) -> DataFrame:
        """Of lines (doc_id, th, at, key, shard), those that their shard's filter may hold."""
        spark: SparkSession = lines.sparkSession
        size = self.filters.agg(F.sum(F.length("table"))).first()[0] or 0
        if size > BROADCAST_FILTERS:
            return self._by_shard(lines)
        held = spark.sparkContext.broadcast({r["shard"]: bytes(r["table"]) for r in self.filters.collect()})  # at most BROADCAST_FILTERS bytes

        def probe(it):
            filters = {s: _hold(t) for s, t in held.value.items()}
            for b in it:
                if not len(b):
                    continue
                keys, shards = _keys(b.column(3)), b.column(4).to_numpy()
                may = np.zeros(len(b), bool)
                by = np.argsort(shards, kind="stable")
                cuts = np.flatnonzero(np.diff(shards[by], prepend=-1))
                for a, z in zip(cuts, [*cuts[1:], len(by)]):
                    if made := filters.get(int(shards[by[a]])):
                        may[by[a:z]] = made.contains(keys[by[a:z]])
                yield b.filter(pa.array(may))

        return lines.mapInArrow(probe, lines.schema)

    def _by_shard(self, lines: DataFrame) -> DataFrame:
        """passing() where filters are large: each task has one filter at a time, which comes ahead of the lines of its shard and salt."""
        dealt = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id", "th", "at"), F.lit(SALTS))).withColumn("table", F.lit(None).cast("binary"))
        tables = self.filters.select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("th"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("binary").alias("key"), "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"), "table")
        both = dealt.unionByName(tables).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("table").isNull())

        def probe(it):
            shard, made = None, None
            for b in it:
                shards = b.column(4).to_numpy()
                opens = np.flatnonzero(b.column(6).is_valid().to_numpy(zero_copy_only=False))
                cuts = sorted({0, *opens.tolist(), *(np.flatnonzero(np.diff(shards)) + 1).tolist()})
                for a, z in zip(cuts, [*cuts[1:], len(b)]):
                    if a >= z:
                        continue
                    if shards[a] != shard:
                        shard, made = shards[a], None
                    if b.column(6)[a].is_valid:
                        made = _hold(b.column(6)[a].as_py())
                        a += 1
                    if made is not None and a < z:
                        part = b.slice(a, z - a)
                        part = part.filter(pa.array(made.contains(_keys(part.column(3)))))
                        yield pa.RecordBatch.from_arrays(part.columns[:5], names=part.schema.names[:5])

        return both.mapInArrow(probe, lines.schema)

    def dropped(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, th, at): places of the lines that go, for each document that loses any; rows of one doc_id and text share a row."""
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("th"), F.posexplode(F.transform(_lines(F.col(text_col)), lambda x: line_key(x, self.least))).alias("at", "key"))
        rows = rows.where("key is not null").withColumn("shard", _shard(F.col("key"), self.shards))
        hot = self.counts.where(F.col("n_docs") >= self.min_docs).select("key")
        return self.passing(rows).join(hot, "key").groupBy("doc_id", "th").agg(F.collect_set("at").alias("at"))

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, n_lines, n_dropped, kept_text) for each row of docs.

        Null and empty texts are one empty line, which stays: lines shorter than `least` code points are
        never dropped. A document that loses every line has the kept text ''. Repeated rows each count as a
        document and get the same result. Extra columns are ignored.
        """

        @F.pandas_udf("string")
        def without(text: pd.Series, at: pd.Series) -> pd.Series:
            def one(t, gone):
                if t is None:
                    return None
                gone = set(gone)
                return "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)

            return pd.Series([one(t, g) for t, g in zip(text, at)], dtype=object)

        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("th"))
        rows = with_document(rows, self.dropped(docs, id_col, text_col), "left")
        cut = without(F.when(F.col("at").isNotNull(), F.col("text")), F.col("at"))
        n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
        return rows.select("doc_id", n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("at"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce(cut, "text").alias("kept_text"))


def op4_cuckoo(spark, sf_dir: str) -> DataFrame:
    """Query op4: lines of at least 1 code point found in at least 10 documents go."""
    docs = documents(spark, sf_dir)
    out = LineIndex.build(docs, least=1, min_docs=10).apply(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op4_sql() -> str:
    """The same in DuckDB."""
    return """
WITH d AS (SELECT row_number() OVER () AS r, doc_id::BIGINT AS doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, j, lines[j] AS line, translate(trim(lines[j], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM d, unnest(range(1, len(lines) + 1)) t(j)),
hot AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10),
m AS (SELECT l.*, hot.k IS NOT NULL AS gone FROM l LEFT JOIN hot ON l.k = hot.k),
g AS (SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY j) FILTER (NOT gone), '') AS kept FROM m GROUP BY r)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_dropped::BIGINT AS n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN g USING (r)"""
