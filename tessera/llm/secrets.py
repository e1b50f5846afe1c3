"""Secret scan: keyword automaton first, anchored patterns near its hits, then embedded checksums.

An Aho-Corasick automaton walks each text once.  Only where it reports a keyword is a pattern
tried, anchored at that place; matches of one kind never overlap, as a left-to-right search would
have it.  Long hexadecimal runs have no keyword and are found on the bytes of a whole batch at once.
Tokens that carry a checksum of their own (a prefix, 30 characters and their CRC-32 in base 62) are
kept only if it holds.

Spans are code points, end exclusive; of spans that start together the kinds' order decides.  A null text
counts as empty and has no spans; null and repeated doc_ids give a row each.  Texts count whole, whatever
their length.  The scan reads doc_id and text only, redaction passes all columns on, so no name can clash.
An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.text import byte_class, slices, split, text_bytes

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "checked")
BASE_KINDS = KINDS[:3]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9_])")
HEX = byte_class((0x30, 0x39), (0x61, 0x66))
HEX_LENGTH, ACCESS_LENGTH, VALUE_LENGTH = 24, 20, 6
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access", "ghp_": "checked", "gho_": "checked", "ghu_": "checked", "ghs_": "checked", "ghr_": "checked", "npm_": "checked"}
LOWER = {c: c + 32 for c in range(65, 91)}

_AUTOMATON: list = []

Span = tuple[int, int, str]


def automaton():
    if not _AUTOMATON:
        import ahocorasick

        made = ahocorasick.Automaton()
        for word, kind in KEYWORDS.items():
            made.add_word(word, (len(word), kind))
        made.make_automaton()
        _AUTOMATON.append(made)
    return _AUTOMATON[0]


def checksum_holds(body: str, check: str) -> bool:
    """The last six characters are the CRC-32 of those before, in base 62."""
    value, digits = zlib.crc32(body.encode()), ""
    while value:
        value, d = divmod(value, 62)
        digits = BASE62[d] + digits
    return digits.rjust(6, "0") == check


def keyword_spans(text: str) -> list[Span]:
    """Spans of all kinds that start with a keyword."""
    lowered = text.lower()
    if len(lowered) != len(text):  # a letter whose lower case is longer
        lowered = text.translate(LOWER)
    hits = sorted((end - size + 1, kind) for end, (size, kind) in automaton().iter(lowered))
    spans: list[Span] = []
    free = dict.fromkeys(KINDS, 0)
    for at, kind in hits:
        if at < free[kind]:
            continue
        if kind == "assign":
            if found := ASSIGN.match(text, at):
                free[kind] = found.end()
                if len(found[2]) >= VALUE_LENGTH:
                    spans.append((at, found.end(), kind))
        elif kind == "access":
            if found := ACCESS.match(text, at):
                free[kind] = found.end()
                if found.end() - at >= ACCESS_LENGTH:
                    spans.append((at, found.end(), kind))
        elif (found := CHECKED.match(text, at)) and checksum_holds(found[1], found[2]):
            free[kind] = found.end()
            spans.append((at, found.end(), kind))
    return spans


def hex_spans(texts: pa.Array) -> dict[int, list[Span]]:
    """Long runs of hexadecimal digits, by row."""
    runs = split(texts, HEX)
    long = np.flatnonzero(runs.ends - runs.starts >= HEX_LENGTH)
    if not len(long):
        return {}
    buf, offsets = text_bytes(texts)
    out: dict[int, list[Span]] = {}
    rows = np.searchsorted(runs.first, long, "right") - 1
    before: dict[int, tuple[int, int]] = {}
    for row, i in zip(rows.tolist(), long.tolist(), strict=True):
        begin, size = int(runs.starts[i]), int(runs.ends[i] - runs.starts[i])
        at, points = before.get(row, (int(offsets[row]), 0))
        points += int(np.count_nonzero((buf[at:begin] & 0xC0) != 0x80))
        before[row] = begin, points
        out.setdefault(row, []).append((points, points + size, "hex"))
    return out


def _spans(texts: pa.Array) -> list[list[Span]]:
    hexes = hex_spans(texts)
    out = []
    for row, text in enumerate(texts.to_pylist()):
        spans = (keyword_spans(text) if text else []) + hexes.get(row, [])
        out.append(sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of every document: structs of start, end and kind in order."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for batch in batches:
            for part in slices(batch, "text"):
                spans = [[{"start": s, "end": e, "kind": k} for s, e, k in row] for row in _spans(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, "doc_id long, spans array<struct<start: long, end: long, kind: string>>")


def report(found: DataFrame) -> DataFrame:
    """Counts by kind, a digest of the base spans, and all spans as text."""

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *counts[:3], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), counts[3])


def redact(docs: DataFrame, changed: str | None = None) -> DataFrame:
    """The documents with every secret replaced by its kind; all rows and all other columns stay as they are.

    changed names a further column, which no other is named like, that tells whether a text was changed.
    """
    schema = docs.schema if changed is None else T.StructType([*docs.schema, T.StructField(changed, T.BooleanType())])
    names = docs.columns

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts, told = part.column("text").to_pylist(), []
                for row, spans in enumerate(_spans(part.column("text"))):
                    told.append(bool(spans))
                    if spans:
                        texts[row] = _without(texts[row], spans)
                columns = {n: part.column(n) for n in names} | {"text": pa.array(texts, pa.string())}
                if changed is not None:
                    columns[changed] = pa.array(told, pa.bool_())
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.mapInArrow(replace, schema)


def _without(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]
