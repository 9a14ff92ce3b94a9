"""Scalar expressions: labels, caps, JSON coercions, tags. All are built-in Spark functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT = "default"
#: Caps in characters.
PROJECT_CHARS, ITEM_CHARS, PAYLOAD_CHARS = 64, 400, 4000


def norm_project(c: Column) -> Column:
    """Tenant label: trimmed, 64 characters; null and empty are 'default'."""
    return F.coalesce(F.nullif(F.left(F.trim(c), F.lit(PROJECT_CHARS)), F.lit("")), F.lit(DEFAULT))


def capped(c: Column, n: int) -> Column:
    return F.left(c, F.lit(n))


def one_line(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def item_line(c: Column) -> Column:
    """A bounded single line."""
    s = one_line(c)
    return F.when(F.length(s) <= ITEM_CHARS, s).otherwise(F.concat(F.left(s, F.lit(ITEM_CHARS - 3)), F.lit("...")))


def origin_tag(row_project: Column, row_origin: Column, project: Column) -> Column:
    """'' for a row of the reader's own project, else where it comes from; a null reader sees no tags."""
    rp = F.coalesce(F.nullif(F.trim(row_project), F.lit("")), F.lit(DEFAULT))
    origin = F.when(row_origin.isNotNull() & (row_origin != "") & (row_origin != rp), F.concat(F.lit("[origin:"), F.left(row_origin, F.lit(60)), F.lit("]"))).otherwise("")
    return F.when(project.isNull() | (rp == project), "").otherwise(F.concat(F.lit("[from project:"), rp, F.lit("]"), origin, F.lit(" ")))


def clean_label(c: Column) -> Column:
    """Letters, digits and -_. only, 64 characters."""
    return F.left(F.regexp_replace(c, r"[^\p{L}\p{N}._-]", ""), F.lit(PROJECT_CHARS))


def project_from_path(path: Column, explicit: Column | None = None) -> Column:
    """Tenant of a working folder: an explicit label, else the last segment over both separators, drives dropped."""
    plain = F.regexp_replace(F.translate(path, "\\", "/"), "^[A-Za-z]:", "")
    parts = F.filter(F.split(plain, "/"), lambda x: F.trim(x) != "")
    last = F.when(F.size(parts) > 0, clean_label(F.element_at(parts, -1)))
    named = F.nullif(clean_label(F.trim(explicit)), F.lit("")) if explicit is not None else F.lit(None).cast("string")
    return norm_project(F.coalesce(named, last))


def payload_object(payload: Column, *keys: str) -> Column:
    """Some fields of a payload as a struct of JSON values, parsed once; null where it is not a whole JSON object.

    The parse counts as not deterministic, so that the optimizer neither copies it into every use nor pushes filters on its
    fields below it: plans stay small.
    """
    parsed = F.from_json(F.coalesce(payload, F.lit("{}")), ", ".join([*(f"`{k}` variant" for k in keys), "__broken string"]), {"columnNameOfCorruptRecord": "__broken"})
    return F.when(F.monotonically_increasing_id() >= 0, parsed)


def fields(v: str, *keys: str) -> list[Column]:
    """Columns <key>_text and <key>_type of a column made by payload_object. Select that column first, so it is parsed once."""
    whole = F.col(f"{v}.__broken").isNull()
    return [c for k in keys for c in (F.when(whole, F.try_variant_get(F.col(f"{v}.{k}"), "$", "string")).alias(f"{k}_text"), F.when(whole, F.schema_of_variant(F.col(f"{v}.{k}"))).alias(f"{k}_type"))]


def as_text(key: str) -> Column:
    return F.col(f"{key}_text")


def _is_string(key: str) -> Column:
    return F.coalesce(F.col(f"{key}_type") == "STRING", F.lit(False))


def truthy(key: str) -> Column:
    """Whether the field is there and not empty, zero, false or null; a string counts by its length, whatever it spells."""
    text = as_text(key)
    number = F.coalesce(text.try_cast("double") != 0, ~text.isin("false", "[]", "{}"))
    return F.coalesce(F.when(_is_string(key), text != "").otherwise(number), F.lit(False))


def text_or(key: str, default: Column, n: int) -> Column:
    return F.left(F.when(truthy(key), as_text(key)).otherwise(default), F.lit(n))


def as_long(key: str) -> Column:
    """A whole number: fractions of JSON numbers are cut, true is 1, a string must spell a whole number; else null."""
    text = F.trim(as_text(key))
    plain = F.when(text == "true", 1).when(text == "false", 0).otherwise(F.coalesce(text.try_cast("long"), text.try_cast("double").try_cast("long")))
    return F.when(_is_string(key), F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("long"))).otherwise(plain).cast("long")


def too_long(key: str) -> Column:
    """Whether the field is a whole number that 64 bits do not hold."""
    text = F.trim(as_text(key))
    return F.coalesce(text.rlike(r"^[+-]?[0-9]{19,}$") & text.try_cast("long").isNull(), F.lit(False))


def error_flag(response: Column) -> Column:
    """1 if the first 80 characters name an error."""
    return F.contains(F.lower(F.left(F.coalesce(response, F.lit("")), F.lit(80))), F.lit("error")).cast("int")


def agent_id(session: Column) -> Column:
    return F.concat(F.lit("cc-"), F.left(session, F.lit(8)))


def subject_tokens(c: Column) -> Column:
    """Lower-case alphanumeric tokens of four characters or more."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: F.length(t) >= 4)


def event_hash(project: Column, kind: Column, actor: Column, session: Column, payload: Column) -> Column:
    """Identity of an event; its time is not part of it."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in (project, kind, actor, session, payload))), 256)


def ref_kind(ref: Column) -> Column:
    return F.substring_index(ref, ":", 1)


def ref_ident(ref: Column) -> Column:
    """The number behind 'kind:number', else null."""
    return F.when(ref.rlike("^[a-z]+:[0-9]+$"), F.substring_index(ref, ":", -1).try_cast("long"))
