"""Personal data: base patterns, and bootstrapped contexts that find what the base patterns miss.

Base spans are the seeds. What stands around a mention, at several degrees of generality (two words, one word, a label, the shapes of
the words and of the value), are lexical patterns; patterns and the values found in them are the two sides of a graph.
In each round Spark scores a pattern by the confidence of its values and a value by its best pattern, until nothing
changes. A pattern of high confidence with enough values then names the identifier-like strings in its contexts that
no base pattern took, if their character class is one that the seeds of that kind show. Scores are whole millionths, so they
do not depend on the order in which rows are summed.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import count

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import documents, materialize, with_document

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Possessive forms and look-behinds match the same strings in linear time.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TOKEN = re.compile(r"\S+")
#: How the @ and the dot of an address are spelled out; punctuation that is not part of an identifier.
AT, DOT = frozenset(("(at)", "[at]", "{at}", "<at>")), frozenset(("(dot)", "[dot]", "{dot}", "<dot>"))
EDGE = ".,;:!?\"'()[]{}<>*%$#&|=-"
MARK = re.compile(r"[@0-9]|[(\[{<][aA][tT][)\]}>]")
LETTER = re.compile(r"[^\W\d_]")
RUNS = ((re.compile("[0-9]+"), "0"), (re.compile("[a-z]+"), "a"), (re.compile("[A-Z]+"), "A"), (re.compile(r"[^\W\d_a-zA-Z]+"), "u"))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(DIGIT.findall(s))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) in code points, by kind, then start."""
    out, at, done = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split(".")))]
        for m in CARD.finditer(text):
            if 13 <= m.end() - m.start() and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def loose_spans(text: str, base: list[tuple[int, int, int]], tokens: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Identifier-like spans beside the base ones: tokens that hold a digit or an @, runs of tokens without letters, spelled-out
    addresses; without the punctuation at their ends."""
    held = _merged([(a, z) for _, a, z in base])
    words = [text[a:z] for a, z in tokens]
    out, k = [], 0
    while k < len(tokens):
        a, z = tokens[k]
        j = k + 1
        if j + 1 < len(tokens) and words[j].lower() in AT:
            j = k + 3
            while j + 1 < len(tokens) and words[j].lower() in DOT:
                j += 2
            z = tokens[j - 1][1]
        elif not MARK.search(words[k]):
            k += 1
            continue
        elif not LETTER.search(words[k]):
            while j < len(tokens) and DIGIT.search(words[j]) and not LETTER.search(words[j]):
                z = tokens[j][1]
                j += 1
        for a, z in _without(a, z, held) if held else [(a, z)]:
            while a < z and text[a] in EDGE:
                a += 1
            while a < z and text[z - 1] in EDGE:
                z -= 1
            if a < z and MARK.search(text, a, z):
                out.append((a, z))
        k = j
    return out


def _without(a: int, z: int, held: list[list[int]]) -> list[tuple[int, int]]:
    """What the held spans leave of a span, without white space at the ends of the parts."""
    out = []
    for x, y in held[max(0, bisect_right(held, [a, a]) - 1) :]:
        if x >= z:
            break
        if y > a:
            out.append((a, min(x, z)))
            a = max(a, y)
    return [p for p in [*out, (a, z)] if p[0] < p[1]]


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, z in sorted(spans):
        if out and a < out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return out


def shape(s: str) -> str:
    """A string with each run of digits, small, capital or other letters as one character."""
    for run, mark in RUNS:
        s = run.sub(mark, s)
    return s


def value_class(value: str) -> str:
    """The character class of a value: an address, letters and digits, or digits by their number."""
    if "@" in value or any(x in value.lower() for x in AT):
        return "at"
    n = len(_digits(value))
    return "mixed" if LETTER.search(value) else "0" if n < 4 else "4" if n < 8 else "8" if n < 13 else "13"


def contexts(text: str, start: int, end: int, tokens: list[tuple[int, int]], ends: list[int]) -> list[str]:
    """The lexical patterns around a span. tokens: all of the text, whole; ends: their ends."""
    k = bisect_right(ends, start)
    left = [DIGIT.sub("0", text[a:z].lower()) for a, z in tokens[max(0, k - 2) : k]]
    j = bisect_left(tokens, (end, end))
    right = [DIGIT.sub("0", text[a:z].lower()) for a, z in tokens[j : j + 1]]
    kind = value_class(text[start:end])
    around = [shape(left[-1]) if left else "", shape(right[0]) if right else ""]
    found = ["\t".join(["shapes", around[0], kind, around[1]])] if not all(x in ("", "a", "u", "au", "ua") for x in around) else []  # plain words tell nothing
    if left:
        found.append("\t".join(["word", left[-1], kind]))
        if left[-1][-1] in ":=#":
            found.append("\t".join(["label", left[-1]]))
    if len(left) == 2:
        found.append("\t".join(["before", *left]))
    if left and right:
        found.append("\t".join(["between", left[-1], right[0]]))
    return found


def mentions_of(text: str) -> list[dict]:
    """Every mention of a text: base spans with their kind, loose ones with kind -1; value and patterns as hashes."""
    if not MARK.search(text):
        return []
    base = base_spans(text)
    tokens = [m.span() for m in TOKEN.finditer(text)]
    ends = [z for _, z in tokens]
    hashed = lambda s: xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)
    spans = base + [(-1, a, z) for a, z in loose_spans(text, base, tokens)]
    return [{"kind": kind, "start": a, "end": z, "value": hashed(text[a:z].lower()), "class": value_class(text[a:z]), "patterns": [hashed(p) for p in contexts(text, a, z, tokens, ends)]} for kind, a, z in spans]


MENTION = "struct<kind: int, start: int, end: int, value: long, class: string, patterns: array<long>>"
_MENTION = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.int64()), ("class", pa.string()), ("patterns", pa.list_(pa.int64()))])


def mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, mentions) for each row: its base spans and its identifier-like ones. A null or empty text has none."""

    def scan(it):
        for b in it:
            found = [mentions_of(t or "") for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(_MENTION))], names=["doc_id", "th", "mentions"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("th"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scan, f"doc_id long, th long, mentions array<{MENTION}>")


#: A confidence of 1; and tenths of a value that every pattern is taken to hold besides, of no kind (1.64 squared, the lower bound of a share near 1).
SURE, DOUBT = 1_000_000, 27


def bootstrap(edges: DataFrame, least_conf: float = 0.8, least_values: int = 5, class_share: float = 0.01) -> DataFrame:
    """edges: distinct (pattern, value, class, kind), kind -1 where no base pattern took the value -> (pattern, kind, conf, held, class).

    A pattern's confidence in a kind is the summed confidence of its values in that kind over all its values and DOUBT more (so 11
    values, all sure, reach 0.8); a value's is 1 in its own kind for seeds, else that of its best pattern of least_conf or more, in
    kinds whose seeds show its class (at least class_share of them). A value that no trusted pattern names has none, so a pattern
    cannot raise itself. Patterns of fewer than least_values different values leave the graph at once. Returned are
    the patterns to be trusted, of least_conf and least_values values of the kind (held), with each class they may name. An
    empty graph trusts nothing.
    """
    wide = edges.groupBy("pattern").agg(F.count_distinct("value").alias("n")).where(F.col("n") >= least_values)
    seeds = edges.where("kind >= 0").select("kind", "value", "class").distinct()
    shown = seeds.groupBy("kind", "class").agg(F.count(F.lit(1)).alias("shown"))
    sizes = shown.groupBy("kind").agg(F.sum("shown").alias("all"))
    classes = materialize(shown.join(sizes, "kind").where(F.col("shown") >= class_share * F.col("all")).select("kind", "class"), "pii-classes")
    edges = materialize(edges.join(wide, "pattern"), "pii-edges")
    sure = edges.where("kind >= 0").select("kind", "value", F.lit(SURE).cast("long").alias("c")).distinct()
    loose = edges.where("kind < 0").select("pattern", "value", "class").distinct().join(F.broadcast(classes), "class")  # a few classes of each kind
    values, before = sure, None
    for k in count():
        scored = edges.select("pattern", "value", "n").distinct().join(values, "value").groupBy("pattern", "kind").agg(F.sum("c").alias("s"), F.count(F.lit(1)).alias("held"), F.min("n").alias("n"))
        patterns = materialize(scored.where(F.col("held") >= least_values).select("pattern", "kind", F.expr(f"10 * s div (10 * n + {DOUBT})").alias("conf"), "held"), f"pii-patterns-{k}")
        now = patterns.agg(F.count(F.lit(1)), F.sum(F.xxhash64("pattern", "kind", "conf", "held").cast("decimal(38)"))).first()
        if now == before:
            break
        before = now
        more = loose.join(patterns.where(F.col("conf") >= int(least_conf * SURE)), ["pattern", "kind"]).groupBy("kind", "value").agg(F.max("conf").alias("c"))
        values = sure.unionByName(more)
    return patterns.where(F.col("conf") >= int(least_conf * SURE)).join(F.broadcast(classes), "kind").select("pattern", "kind", "conf", "held", "class")


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_id, base, spans) for each row of docs: arrays of (kind, start, end) by kind, then start.

    kind counts along KINDS; offsets are code points, end exclusive. spans holds base and what contexts added: a loose span in
    contexts of several kinds goes to the most confident one, then to that of more values, then to the first kind.
    A null text is empty. Rows that share doc_id and text get the same result. Extra columns are ignored.
    """
    rows = materialize(mentions(docs, id_col, text_col), "mentions")
    each = rows.select("doc_id", "th", F.explode("mentions").alias("m")).select("doc_id", "th", "m.*")
    edges = each.select(F.explode("patterns").alias("pattern"), "value", "class", "kind").groupBy("pattern", "value", "class").agg(F.max("kind").alias("kind"))
    trusted = bootstrap(edges, **how)
    loose = each.where("kind < 0").select("doc_id", "th", "start", "end", "class", F.explode("patterns").alias("pattern"))
    best = loose.join(trusted, ["pattern", "class"]).groupBy("doc_id", "th", "start", "end").agg(F.max(F.struct("conf", "held", (-F.col("kind")).alias("minus"))).alias("b"))
    added = best.groupBy("doc_id", "th").agg(F.collect_set(F.struct((-F.col("b.minus")).alias("kind"), "start", "end")).alias("added"))
    base = F.transform(F.filter("mentions", lambda m: m["kind"] >= 0), lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    out = with_document(rows.select("doc_id", "th", base.alias("base")), added, "left")
    empty = F.array().cast("array<struct<kind: int, start: int, end: int>>")
    return out.select("doc_id", F.sort_array("base").alias("base"), F.sort_array(F.concat("base", F.coalesce("added", empty))).alias("spans"))


def op1_bootstrap(spark, sf_dir: str) -> DataFrame:
    """Query op1: every document."""
    names = F.array(*map(F.lit, KINDS))
    told = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    out = extract(documents(spark, sf_dir))
    return out.select("doc_id", *map(count, range(4)), F.sha2(told("base").cast("binary"), 256).alias("base_sha256"), told("spans").alias("spans"))
