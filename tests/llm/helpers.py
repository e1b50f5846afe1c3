"""Fixtures that every document operator must take: nulls, empty texts, ties, repeats, extra columns."""

import re

DOCS = "doc_id long, text string, lang string, part int, rank int, block int"
#: Lower-cased words of the benchmark rule.
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def documents(spark, sf_dir):
    """Rows of the real table with odd rows beside them; the extra columns clash with internal names."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    texts = [None, "", " \n\t", "one", "a b a b " * 400, "x" * 70_000, "naïve café — “quoted” 😀 İſK", rows[3][1], rows[3][1] + " tail", "tok <|endoftext|> it's '|' A1b2"]
    rows += [(10_000 + i, t) for i, t in enumerate(texts)]
    return rows, spark.createDataFrame([(i, t, "en", 1, 2, 3) for i, t in rows], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
