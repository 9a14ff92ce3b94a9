"""Benchmark decontamination with a distributed positional inverted index; DataFrame functions only.

1. One pass over the corpus counts the benchmark's own terms.
2. Each window of 13 item words names its rarest terms. A second pass stores the postings of those terms
   alone: (term, document, positions).
3. Lists are intersected after adjusting for offset: a posting at p and an item term at i meet on the
   diagonal p - i; a window survives where all its rarest terms lie on one diagonal.
4. Survivors are compared word for word with the document (exact phrase). The same lists within a slop give
   proximity matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, benchmark, documents, lowered, materialize, unveiled, veiled, with_document

WIDTH = 13
RAREST = 2
#: Fixed value: the ASCII characters that part words, as a Java regex; A-Z are lowered word by word.
PARTING = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: Broadcast bounds: bytes of benchmark text, bytes of its different terms, and keys of candidate documents. Beyond them joins shuffle.
BROADCAST_TEXT = 4 << 20
BROADCAST_TERMS = 32 << 20
BROADCAST_KEYS = 200_000


def _parts(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), PARTING, -1)


def _lead(parts: Column) -> Column:
    """Empty strings before the first word."""
    return (F.get(parts, F.lit(0)) == "").cast("int")


def _n_words(parts: Column) -> Column:
    return F.size(parts) - _lead(parts) - ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows that share doc_id and text are one document here; they get the same result."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("th"), _parts(F.col(text_col)).alias("parts"))


def corpus_terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, pos, term): every word of every document."""
    rows = _keyed(docs, id_col, text_col).select("doc_id", "th", _lead(F.col("parts")).alias("lead"), F.posexplode("parts").alias("at", "raw"))
    return rows.where("raw <> ''").select("doc_id", "th", (F.col("at") - F.col("lead")).alias("pos"), lowered(F.col("raw")).alias("term"))


class Index:
    """The items' windows, their rarest terms, and those terms' postings over a corpus."""

    def __init__(self, docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH, rarest: int = RAREST):
        self.docs, self.id_col, self.text_col = docs, id_col, text_col
        size = items.agg(F.sum(F.octet_length(F.col(item_text).cast("string")))).first()[0] or 0
        self.near = F.broadcast if size <= BROADCAST_TEXT else (lambda df: df)
        item = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item_id"), F.col(item_text).cast("string").alias("text")).distinct()
        words = F.transform(F.filter(_parts(F.col("text")), lambda x: x != ""), lowered)
        self.items = materialize(item.select("item_id", F.xxhash64("item_id", "text").alias("item"), words.alias("words")).where(F.size("words") > 0), "items")
        terms = self.items.select("item", F.posexplode("words").alias("ipos", "term"))
        vocabulary = materialize(terms.select("term").distinct(), "item-terms")
        held = vocabulary.agg(F.sum(F.octet_length("term") + 32)).first()[0] or 0
        self.near_terms = F.broadcast if held <= BROADCAST_TERMS else (lambda df: df)
        corpus = corpus_terms(docs, id_col, text_col)
        counts = materialize(corpus.join(self.near_terms(vocabulary), "term").groupBy("term").count(), "term-counts")
        n, span = F.size("words"), F.least(F.size("words"), F.lit(width))
        starts = self.items.select("item", span.alias("len"), F.explode(F.sequence(F.lit(0), n - span)).alias("s"))
        places = starts.select("item", "s", "len", F.explode(F.sequence(F.col("s"), F.col("s") + F.col("len") - 1)).alias("ipos"))
        inside = places.join(terms, ["item", "ipos"]).join(counts, "term", "left").select("item", "s", "len", "term", "ipos", F.coalesce("count", F.lit(0)).alias("cf"))
        ranked = inside.groupBy("item", "s", "len", "term").agg(F.min("ipos").alias("ipos"), F.min("cf").alias("cf"))
        lists = F.sort_array(F.collect_list(F.struct("cf", "term", "ipos")))
        chosen = ranked.groupBy("item", "s", "len").agg(F.slice(lists, 1, rarest).alias("sel")).where("sel[0].cf > 0")  # a term that never occurs rules its windows out
        self.windows = materialize(chosen, "item-windows")
        self.sought = self.windows.select("item", F.explode("sel").alias("x")).select("item", F.col("x.term").alias("term"), F.col("x.ipos").alias("ipos")).distinct()
        held = corpus.join(self.near_terms(self.sought.select("term").distinct()), "term")
        self.postings = materialize(held.groupBy("term", "doc_id", "th").agg(F.sort_array(F.collect_list("pos")).alias("positions")), "postings")

    def _diagonals(self) -> DataFrame:
        """(doc_id, th, item, diag, windows): windows all of whose rarest terms lie on the diagonal.

        A place asks for the few windows that chose it, so a long item costs what its matches cost.
        """
        met = self.postings.join(self.near(self.sought), "term").select("doc_id", "th", "item", "ipos", F.explode("positions").alias("pos"))
        found = met.groupBy("doc_id", "th", "item", (F.col("pos") - F.col("ipos")).alias("diag")).agg(F.collect_set("ipos").alias("got"))
        need = self.windows.select("item", "s", "len", F.size("sel").alias("need"), F.explode(F.transform("sel", lambda x: x["ipos"])).alias("ipos"))
        fewest = self.windows.groupBy("item").agg(F.min(F.size("sel")).alias("fewest"))
        left = found.join(self.near(fewest), "item").where(F.size("got") >= F.col("fewest")).select("doc_id", "th", "item", "diag", F.explode("got").alias("ipos"))
        whole = left.join(self.near(need), ["item", "ipos"]).where("diag + s >= 0").groupBy("doc_id", "th", "item", "diag", "s", "len", "need").agg(F.count(F.lit(1)).alias("n")).where("n = need")
        return whole.groupBy("doc_id", "th", "item", "diag").agg(F.collect_list(F.struct("s", "len")).alias("windows"))

    def phrases(self) -> DataFrame:
        """(doc_id, th, item_id, start, len): every exact occurrence of a window; repeated rows of docs give theirs once."""
        found = materialize(self._diagonals().groupBy("doc_id", "th").agg(F.collect_list(F.struct("item", "diag", "windows")).alias("cands")), "candidates")
        text = F.col(self.text_col).cast("string")
        docs = self.docs.select(F.col(self.id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
        keys = found.select("doc_id", "th")
        docs = with_document(docs, F.broadcast(keys) if found.count() <= BROADCAST_KEYS else keys, "left_semi").dropDuplicates(["doc_id", "th"])
        docs = docs.select("doc_id", "th", _parts(F.col("text")).alias("parts"))
        rows = with_document(docs, found).select("doc_id", "th", "parts", F.explode("cands").alias("c"))
        low, high = F.array_min("c.windows.s"), F.array_max(F.transform("c.windows", lambda w: w["s"] + w["len"]))
        cut = F.slice("parts", _lead(F.col("parts")) + F.col("c.diag") + low + 1, high - low)
        rows = rows.select("doc_id", "th", F.col("c.item").alias("item"), F.col("c.diag").alias("diag"), F.col("c.windows").alias("windows"), low.alias("low"), F.transform(cut, lowered).alias("cut"))
        rows = rows.join(self.near(self.items), "item")
        equal = lambda w: F.slice("cut", w["s"] - F.col("low") + 1, w["len"]) == F.slice("words", w["s"] + 1, w["len"])
        rows = rows.select("doc_id", "th", "item_id", "diag", F.explode(F.filter("windows", equal)).alias("w"))
        return rows.select("doc_id", "th", "item_id", (F.col("diag") + F.col("w.s")).alias("start"), F.col("w.len").alias("len"))

    def proximity(self, slop: int = 5) -> DataFrame:
        """(doc_id, th, item_id, s, len): windows whose rarest terms all occur near their places, order free within slop.

        Each of the other rarest terms lies within slop words of where the first one puts it; s is the window's start in the item.
        Null and empty texts match nothing; repeated rows give theirs once.
        """
        want = self.windows.select("item", "s", "len", F.col("sel")[0].alias("a"), F.explode("sel").alias("b"))
        want = want.select("item", "s", "len", F.col("a.term").alias("a_term"), F.col("b.term").alias("term"), (F.col("b.ipos") - F.col("a.ipos")).alias("gap"))
        anchors = self.postings.select(F.col("term").alias("a_term"), "doc_id", "th", F.explode("positions").alias("at"))
        rows = anchors.join(self.near(want), "a_term")
        others = self.postings.select("term", F.col("doc_id").alias("o_id"), F.col("th").alias("o_th"), "positions")
        rows = rows.join(others, (rows["term"] == others["term"]) & rows["doc_id"].eqNullSafe(F.col("o_id")) & (rows["th"] == F.col("o_th")))
        rows = rows.where(F.exists("positions", lambda p: F.abs(p - F.col("at") - F.col("gap")) <= slop))
        found = rows.groupBy("doc_id", "th", "item", "s", "len", "at").agg(F.count(F.lit(1)).alias("n"))
        need = self.windows.select("item", "s", F.size("sel").alias("need"))
        found = found.join(self.near(need), ["item", "s"]).where("n = need").select("doc_id", "th", "item", "s", "len").distinct()
        return found.join(self.near(self.items.select("item", "item_id")), "item").select("doc_id", "th", "item_id", "s", "len")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH, rarest: int = RAREST) -> DataFrame:
    """(doc_id, th, n_words, n_hit, n_items, items_sha256, contaminated) for each row of docs.

    A document word inside any occurrence of an item window is hit; contaminated: some word is, and at least
    one in 20. A null or empty text has no words and is clean; items without words have no window; a null
    item_id counts as ''. Repeated rows get the same result each. Extra columns are ignored.
    """
    found = materialize(Index(docs, items, id_col, text_col, item_col, item_text, width, rarest).phrases(), "phrases")
    spans = found.select("doc_id", "th", "start", (F.col("start") + F.col("len")).alias("end")).distinct()
    before = Window.partitionBy("doc_id", "th").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("held", F.coalesce(F.max("end").over(before), F.lit(0)))
    hit = spans.groupBy("doc_id", "th").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "held"))).alias("n_hit"))
    named = found.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
    both = with_document(hit, named)
    rows = _keyed(docs, id_col, text_col).select("doc_id", "th", _n_words(F.col("parts")).cast("long").alias("n_words"))
    out = with_document(rows, both, "left").select("doc_id", "th", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))
    contaminated = (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))
    return out.select("doc_id", "th", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("items_sha256"), contaminated.alias("contaminated"))


def remove(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that are not contaminated, all columns as they are, whatever their names; null and empty texts stay."""
    own, id_at, text_at = veiled(docs, id_col, text_col)
    bad = contamination(own, items, id_at, text_at, **how).where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("th").alias("bad_hash")).distinct()
    clean = own.join(bad, F.col(id_at).cast("long").eqNullSafe(F.col("bad_id")) & (F.xxhash64(F.col(text_at).cast("string")) == F.col("bad_hash")), "left_anti")
    return unveiled(clean, docs)


def op3_inverted_index(spark, sf_dir: str) -> DataFrame:
    """Query op3: documents against benchmark, windows of 13 words."""
    return contamination(documents(spark, sf_dir), benchmark(spark, sf_dir)).drop("th")


def op3_sql() -> str:
    """The same in DuckDB, by joining window strings."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id::BIGINT AS doc_id, {words} AS words FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, {words} AS words FROM benchmark),
iw AS (SELECT DISTINCT item_id, least({WIDTH}, len(words)) AS n, array_to_string(words[s:s + least({WIDTH}, len(words)) - 1], ' ') AS w FROM i, unnest(range(1, greatest(len(words) - {WIDTH - 1}, 1) + 1)) t(s) WHERE len(words) > 0),
dw AS (SELECT r, s, n, array_to_string(words[s:s + n - 1], ' ') AS w FROM d, (SELECT DISTINCT n FROM iw) k, unnest(range(1, len(words) - n + 2)) t(s)),
hits AS (SELECT DISTINCT r, s, dw.n AS n, item_id FROM dw JOIN iw ON dw.w = iw.w AND dw.n = iw.n),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hits) GROUP BY r),
named AS (SELECT r, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id, ',' ORDER BY item_id)) AS items_sha256 FROM hits GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)"""
