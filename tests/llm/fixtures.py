"""Small tables with every awkward case, and readers of results."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward():
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    prose = [" ".join(word() for _ in range(120)).capitalize() + "." for _ in range(12)]
    rows = [(k, t, "en" if k % 2 else "de", f"src{k % 3}", len(t)) for k, t in enumerate(prose)]
    rows += [
        (20, None, "en", "src0", None),
        (21, "", None, None, 0),
        (22, " \t\n\r\x0b\x0c ", "en", "src1", 7),
        (23, "1234 5678 !!!", "en", "src1", 13),
        (None, "a row without an id. " * 3, "en", "src1", 60),
        (None, None, None, None, None),
        (24, "Ünïcode ÀÉ straße 日本語 😀 end.\nSecond LINE.\n\nsecond line.", "de", "src2", 50),
        (25, "very long " * 20000, "en", "src12", 200000),
        (26, prose[0], "de", "src0", 5),
        (26, prose[0], "de", "src0", 5),
        (26, prose[1] + " tail", "de", "src0", 5),
        (-5, "x" * 3000, "fr", "src3", 3000),
        (27, "\n".join(["shared line here."] * 3 + [prose[2]]), "en", "src0", 1),
    ]
    rows += [(100 + k, f"shared line here.\n{prose[k % 12]}\n  SHARED Line here.\t", "en", "src0", 1) for k in range(12)]
    return rows


def frame(spark, rows=None, clash=()):
    """rows as documents; clash: names of further string columns."""
    df = spark.createDataFrame(awkward() if rows is None else rows, SCHEMA).repartition(3)
    for name in clash:
        df = df.selectExpr("*", f"'clash' as `{name}`")
    return df


def tuples(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


CLASH = ("th", "fp", "shard", "key", "h", "tokens", "pos", "term", "kind", "value", "root", "rep_id", "slot", "lang_pred", "score", "words", "lines", "text_hash", "bucket", "spans", "item_id", "n", "__x")
