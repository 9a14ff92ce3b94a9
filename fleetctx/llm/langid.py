"""Language ID by interpolated Kneser-Ney character models, one a language, in sorted key arrays.

A text is its lower-cased letters with every run of other characters as one space. An n-gram is packed
into 64 bits, 16 for each character (letters beyond U+FFFE share one code), and the models of all
languages lie side by side: one sorted array of keys for each order, with a column of log probabilities
for each language. The language of lowest cross-entropy per character wins; a text whose entropy is far
above that of the language's own calibration texts is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import documents, unveiled, veiled
from .tokens import blocks

ORDER = 4
SPACE = 32
OTHER = 0xFFFF
UND = "und"
#: Characters whose scores a worker holds at a time.
HELD = 400_000


def symbol_table() -> np.ndarray:
    """For each code point its symbol: the lower-cased letter, or SPACE."""
    table = np.full(0x110000, SPACE, np.uint64)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = min(ord(low) if len(low) == 1 else c, OTHER)
    return table


def symbols(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts in one array, each text opened by one space; and the start of each text."""
    raw = np.frombuffer("\n".join(["", *texts]).encode("utf-32-le", "surrogatepass"), "<u4") if texts else np.zeros(0, "<u4")
    sym = table[raw]
    starts = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])]) if texts else np.zeros(0, np.int64)
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] != SPACE) | (sym[:-1] != SPACE)
    keep[starts] = True
    return sym[keep], (np.cumsum(keep) - 1)[starts]


def grams(sym: np.ndarray, starts: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The packed n-gram that ends at each symbol; what precedes a text is spaces."""
    key = sym.copy()
    at = np.arange(len(sym)) - np.repeat(starts, np.diff(np.append(starts, len(sym))))
    for back in range(1, order):
        before = np.full(len(sym), SPACE, np.uint64)
        before[back:] = sym[:-back] if back else sym
        before[at < back] = SPACE
        key |= before << np.uint64(16 * back)
    return key


def _rows(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted key in the sorted keys, -1 where it is not there."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


@dataclass
class Models:
    """langs; and for each order n (index n - 1) sorted keys with log p, sorted contexts with log backoff weight."""

    langs: list[str]
    keys: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    floor: np.ndarray
    limits: np.ndarray

    def score(self, wanted: np.ndarray, order: int = ORDER) -> np.ndarray:
        """log p of the last character given those before it, a column for each language."""
        if not order:
            return np.broadcast_to(self.floor, (len(wanted), len(self.langs)))
        at = _rows(self.keys[order - 1], wanted)
        miss = np.flatnonzero(at < 0)
        out = self.logp[order - 1][at] if len(self.keys[order - 1]) else np.zeros((len(wanted), len(self.langs)), np.float32)
        if len(miss):
            lost = wanted[miss]
            ctx = _rows(self.contexts[order - 1], lost >> np.uint64(16))
            weight = np.where((ctx < 0)[:, None], 0, self.backoff[order - 1][ctx] if len(self.contexts[order - 1]) else 0)
            out[miss] = weight + self.score(lost & np.uint64((1 << 16 * (order - 1)) - 1), order - 1)
        return out

    def entropies(self, texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cross-entropy per character and language, characters, has a letter) of each text."""
        sym, starts = symbols(texts, table)
        sums = np.add.reduceat(self.score(grams(sym, starts)), starts, axis=0, dtype=np.float64)
        sizes = np.diff(np.append(starts, len(sym)))
        letters = np.add.reduceat((sym != SPACE).astype(np.int64), starts) > 0
        return -sums / sizes[:, None], sizes, letters


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER) -> Models:
    """Interpolated Kneser-Ney from n-gram counts: language -> (sorted packed n-grams, counts)."""
    langs = sorted(counts)
    alphabet = max(len(np.unique(np.concatenate([np.zeros(1, np.uint64), *(k & np.uint64(0xFFFF) for k, _ in counts.values())]))), 2)
    floor = np.full(len(langs), -np.log(alphabet), np.float32)  # one of them stands for characters never seen
    per: dict[str, list] = {}
    for lang, (keys, n) in counts.items():
        levels = [(keys, n)]
        for k in range(order - 1, 0, -1):  # lower orders count the distinct characters before them
            levels.insert(0, np.unique(levels[0][0] & np.uint64((1 << 16 * k) - 1), return_counts=True))
        per[lang] = levels
    m = Models(langs, [], [], [], [], floor, np.full(len(langs), np.inf))
    for k in range(1, order + 1):
        keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *(per[x][k - 1][0] for x in langs)]))
        contexts = np.unique(keys >> np.uint64(16))
        logp, backoff = np.zeros((len(keys), len(langs)), np.float32), np.zeros((len(contexts), len(langs)), np.float32)
        lower = np.exp(m.score(keys & np.uint64((1 << 16 * (k - 1)) - 1), k - 1).astype(np.float64)) if len(keys) else np.zeros((0, len(langs)))
        for j, lang in enumerate(langs):
            own, n = per[lang][k - 1]
            ones, twos = int((n == 1).sum()), int((n == 2).sum())
            d = ones / (ones + 2 * twos) if ones and twos else 0.5
            at = _rows(contexts, own >> np.uint64(16))
            total, kinds = np.bincount(at, n, len(contexts)), np.bincount(at, minlength=len(contexts))
            seen = total > 0
            rest = np.ones(len(contexts))
            rest[seen] = d * kinds[seen] / total[seen]
            p = rest[_rows(contexts, keys >> np.uint64(16))] * lower[:, j]
            p[_rows(keys, own)] += (n - d) / total[at]
            logp[:, j], backoff[:, j] = np.log(p), np.log(rest)
        m.keys.append(keys), m.logp.append(logp), m.contexts.append(contexts), m.backoff.append(backoff)
    return m


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", sample_docs: int = 1500, most_langs: int = 256) -> Models:
    """Models of the languages of labelled rows.

    Fitted on a bounded sample: of each of the most_langs languages with the most rows (ties by name) about sample_docs rows,
    chosen by a hash of key_col (all where there are fewer); one in eight of them is not counted but calibrates the rejection.
    Rows with a null text or language teach nothing; an empty table gives models of no language. n-grams of the sample alone
    reach the driver, so the models are bounded by sample_docs times most_langs texts, whatever the labels hold.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), (F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(key_col).cast("string"), F.lit(""))), 1) / F.lit(float(1 << 63))).alias("u"))
    sizes = rows.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(most_langs)
    sample = rows.join(F.broadcast(sizes), "lang").where(F.col("u") * F.col("count") < sample_docs)  # one row a language
    sample = sample.select("lang", "text", (F.col("u") * F.col("count") * 8 / F.least("count", F.lit(sample_docs)) >= 7).alias("held"))

    def count(it):
        table = symbol_table()
        for b in it:
            for lang, group in b.groupby("lang"):
                for i, j in blocks(texts := group["text"].tolist(), HELD):
                    keys, n = np.unique(grams(*symbols(texts[i:j], table)), return_counts=True)
                    yield pd.DataFrame({"lang": lang, "key": keys.view(np.int64), "n": n})

    counted = sample.where("not held").mapInPandas(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toPandas()
    counts = {}
    for lang, group in counted.groupby("lang"):
        keys = group["key"].to_numpy().view(np.uint64)
        by = np.argsort(keys)
        counts[lang] = (keys[by], group["n"].to_numpy()[by])
    models = build(counts)

    def calibrate(it):
        table = symbol_table()
        for b in it:
            for i, j in blocks(texts := b["text"].tolist(), HELD):
                ce, size, letters = models.entropies(texts[i:j], table)
                best = ce.argmin(axis=1)
                yield pd.DataFrame({"best": best, "ce": ce[np.arange(len(best)), best] - 2 / np.sqrt(size)})[letters]

    if models.langs:
        marks = sample.where("held").mapInPandas(calibrate, "best int, ce double").groupBy("best").agg(F.percentile("ce", F.array(F.lit(0.5), F.lit(0.99))).alias("q")).collect()
        for r in marks:
            far = r.q[0] + 0.5 * (-models.floor[r.best] - r.q[0])  # half the way to characters drawn at random
            models.limits[r.best] = max(r.q[1] + 3 * (r.q[1] - r.q[0]) + 0.5, far)
    return models


def classify(docs: DataFrame, models: Models, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns in carry with lang_pred, score and rejected, for each row.

    und with score 0, rejected, where a text is null or has no letter or no language was learned; ties go
    to the first language by name. score is the winner's share of the likelihoods of 40 characters. Repeated rows get the same
    result each. carry may hold any names but lang_pred, score, rejected and own_text; see veiled() for rows with those.
    """
    spark = docs.sparkSession
    plain = tuple(getattr(models, f.name) for f in fields(Models))  # lists and arrays alone: executors need no copy of this package
    held = spark.sparkContext.broadcast((plain, symbol_table()))
    carry = carry or []
    rows = docs.select(*carry, F.col(text_col).cast("string").alias("own_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]), "lang_pred string", "score double", "rejected boolean"])

    def label(it):
        plain, table = held.value
        models = Models(*plain)
        for b in it:
            texts = [t or "" for t in b.column(b.num_columns - 1).to_pylist()]
            pred, score, rejected = [UND] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            for i, j in blocks(texts, HELD) if models.langs else ():
                ce, size, letters = models.entropies(texts[i:j], table)
                best = ce.argmin(axis=1)
                low = ce[np.arange(len(best)), best]
                share = 1 / np.exp(-np.minimum(size, 40)[:, None] * (ce - low[:, None])).sum(axis=1)
                for k in np.flatnonzero(letters):
                    pred[i + k] = models.langs[best[k]]
                score[i:j] = np.where(letters, share, 0)
                rejected[i:j] = ~letters | (low - 2 / np.sqrt(size) > models.limits[best])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(pred), pa.array(score), pa.array(rejected)], names=[*b.schema.names[:-1], "lang_pred", "score", "rejected"])

    return rows.mapInArrow(label, schema)


def accepted(docs: DataFrame, models: Models, text_col: str = "text") -> DataFrame:
    """The rows of docs that classify() does not reject, all columns as they are, whatever their names."""
    own, text_at = veiled(docs, text_col)
    return unveiled(classify(own, models, text_at, own.columns).where("not rejected"), docs)


def held_out(doc_id) -> Column:
    """crc32 of doc_id as text, modulo 4, is 2; a null doc_id is an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op9_kneser_ney(spark, sf_dir: str) -> DataFrame:
    """Query op9: models of documents that are not held out, applied to all."""
    docs = documents(spark, sf_dir)
    models = train(docs.where(~held_out(F.col("doc_id"))))
    out = classify(docs, models, carry=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
