"""Line-first cleaning: rules on every line, failures removed, documents that lose too much rejected.

DataFrame functions only. A document is cleaned inside its row: nothing is shuffled and no row leaves its task.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WS_CLASS, documents

#: Characters that end a sentence in the scripts that have their own, symbols that markup leaves, separators of menus.
ENDS = ".!?…。！？｡؟۔।॥።။។‼⁇⁈⁉"
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|>»·•"
#: Phrases of lines that belong to a page and not to its text, by language; Java regex.
PHRASES = {
    "en": ("cookies?\\b", "javascript", "all rights reserved", "copyright", "terms of (use|service)", "privacy policy", "sign (up|in)\\b", "log ?in\\b", "subscribe", "click here", "read more", "licensed under", "lorem ipsum"),
    "de": ("alle rechte vorbehalten", "datenschutz", "impressum\\b", "nutzungsbedingungen", "jetzt anmelden", "hier klicken", "weiterlesen"),
    "fr": ("tous droits réservés", "mentions légales", "politique de confidentialité", "conditions d.utilisation", "se connecter", "cliquez ici", "lire la suite"),
    "es": ("todos los derechos reservados", "aviso legal", "política de privacidad", "términos de uso", "iniciar sesión", "haga clic", "leer más"),
}
#: A boilerplate phrase condemns a line of at most this many words.
SHORT_LINE = 40
WINDOW = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value computed once for a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def boilerplate(phrases: Mapping[str, Sequence[str]]) -> str:
    """One regex of the phrases of all languages; a text's language need not be known."""
    return "(?i)" + "|".join(x for some in phrases.values() for x in some)


def line_fails(line: Column, phrases: Mapping[str, Sequence[str]] = PHRASES) -> Column:
    """Whether a line breaks a rule; a line without a word breaks none.

    punctuation: it holds no sentence's end; symbols: at least three, and 3 to 10 words; navigation: at least three separators,
    and one to 4 words, or a link in every second word; letters: fewer than half of its characters beside white space are
    letters; boilerplate: a phrase in a short line.
    """
    pattern = boilerplate(phrases)

    def rules(s: Column) -> Column:
        n = F.size(F.split(s, f"{WS_CLASS}+"))
        no_end = F.length(F.translate(s, ENDS, "")) == F.length(s)
        symbols, bars = _count_of(s, SYMBOLS), _count_of(s, SEPARATORS)
        links = (F.length(s) - F.length(F.replace(s, F.lit("://"), F.lit("")))) / 3
        others = F.length(F.regexp_replace(s, r"[\p{L}\p{M}\s]", ""))
        letters = F.length(F.regexp_replace(s, r"[^\p{L}\p{M}]", ""))
        return (s != "") & (no_end | ((symbols >= 3) & (symbols * 10 >= n * 3)) | ((bars >= 3) & (bars * 4 >= n)) | ((links >= 1) & (links * 2 >= n)) | (letters < others) | ((n <= SHORT_LINE) & s.rlike(pattern)))

    return let(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), rules)


def repeat_words(words: Column, width: int = WINDOW) -> Column:
    """Words that lie in a window of `width` words found twice or more in the text, the first included.

    Windows are compared by a 64-bit hash. Most texts repeat none and stop after one distinct; for the others windows are sorted
    with their places, and the places of equal ones are merged.
    """

    def marked(hashes: Column) -> Column:
        def places(s: Column) -> Column:
            same = lambda j: (F.get(s, j)["h"] == F.get(s, j + 1)["h"])
            at = F.transform(s, lambda e, j: F.when(((j > 0) & F.coalesce(same(j - 1), F.lit(False))) | F.coalesce(same(j), F.lit(False)), e["i"]))
            return F.array_sort(F.filter(at, lambda i: i.isNotNull()))

        def covered(at: Column) -> Column:
            start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
            step = lambda acc, i: F.struct((i + width).alias("end"), (acc["total"] + (i + width) - F.greatest(acc["end"], i)).alias("total"))
            return F.aggregate(at, start, step, lambda acc: acc["total"])

        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(ordered, lambda s: let(places(s), covered)))

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (width - 1)), lambda i: F.xxhash64(F.slice(words, i, width)))
    return F.when(F.size(words) <= width, F.lit(0)).otherwise(let(hashes, marked))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_lost: float = 0.5, phrases: Mapping[str, Sequence[str]] = PHRASES) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_chars, kept_text) for each row.

    A null text has no words and fails. kept: the base rules hold and line cleaning removed at most
    most_lost of the characters; kept_text is what remains (also where the document is rejected).
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("*", F.array_remove(F.split("text", f"{WS_CLASS}+"), "").alias("words"), F.split("text", "\n", -1).alias("lines"))

    def after_lines(failed: Column) -> Column:
        return F.filter(F.col("lines"), lambda x, i: ~F.get(failed, i))

    worded = F.filter("lines", lambda x: x.rlike("[^ \\x09-\\x0D]"))
    rows = rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _count_of(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        let(worded, lambda w: F.size(w) - F.size(F.array_distinct(w))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.length("text").alias("n_chars"),
        F.array_join(let(F.transform("lines", lambda x: line_fails(x, phrases)), after_lines), "\n").alias("kept_text"),
    )
    base_failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    lost = F.col("n_chars") - F.length("kept_text")
    rows = rows.select("*", base_failed.alias("base_failed"), lost.cast("long").alias("lost_chars"))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") <= F.col("n_chars") * most_lost)).drop("n_chars")


def op10_line_rules(spark, sf_dir: str) -> DataFrame:
    """Query op10: every document, at most half of its characters lost."""
    out = measure(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")


def op10_sql() -> str:
    """The same in DuckDB."""
    ws = "[ \\t\\n\\x0B\\f\\r]"
    count = lambda col, chars: f"(length({col}) - length(translate({col}, '{chars}', '')))"
    return f"""
WITH base AS (SELECT row_number() OVER () AS r, doc_id::BIGINT AS doc_id, coalesce(text, '') AS text FROM documents),
parts AS (SELECT *, list_filter(regexp_split_to_array(text, '{ws}+'), lambda x: x <> '') AS words, string_split(text, chr(10)) AS lines FROM base),
wins AS (SELECT r, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS w FROM parts, unnest(range(1, len(words) - {WINDOW - 2})) t(i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM wins) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS p FROM twice) GROUP BY r),
each AS (SELECT r, j, lines[j] AS line, trim(lines[j], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS s FROM parts, unnest(range(1, len(lines) + 1)) t(j)),
counted AS (SELECT *, len(regexp_split_to_array(s, '{ws}+')) AS n, {count('s', SYMBOLS)} AS symbols, {count('s', SEPARATORS)} AS bars,
  (length(s) - length(replace(s, '://', ''))) / 3 AS links, length(regexp_replace(s, '[^\\p{{L}}\\p{{M}}]', '', 'g')) AS letters, length(regexp_replace(s, '[\\p{{L}}\\p{{M}}\\s\\x0B]', '', 'g')) AS others FROM each),
judged AS (SELECT *, s <> '' AND ({count('s', ENDS)} = 0 OR (symbols >= 3 AND symbols * 10 >= n * 3) OR (bars >= 3 AND bars * 4 >= n) OR (links >= 1 AND links * 2 >= n) OR letters < others OR (n <= {SHORT_LINE} AND regexp_matches(s, '{boilerplate(PHRASES)}'))) AS fails FROM counted),
kept AS (SELECT r, coalesce(sum(length(line)) FILTER (NOT fails), 0) + greatest(count(*) FILTER (NOT fails) - 1, 0) AS left_chars,
  count(*) FILTER (s <> '') - count(DISTINCT line) FILTER (s <> '') AS n_dup_lines FROM judged GROUP BY r),
done AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, {count('text', SYMBOLS)}::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words, (length(text) - left_chars)::BIGINT AS lost_chars, length(text) AS n_chars
  FROM parts JOIN kept USING (r) LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost_chars <= n_chars * 0.5 AS kept, lost_chars FROM done"""
