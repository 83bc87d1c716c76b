"""Secret scans by one combined deterministic automaton.

All rules are compiled into one minimal automaton (``automaton.Dfa``) that passes once over a text's bytes and tells
where a match of each rule can end. Only at those places the rule's own reversed automaton finds the start and its
forward automaton the end, so matches are leftmost, longest and non-overlapping for each rule; those that fail the
rule's length are dropped after they have taken their characters, as a regular-expression scan does.

A scan is one narrow pass: no exchange, memory bounded by an Arrow batch of at most 4 MB or one text, whatever its length.

Letters "in either case" are the 26 of ASCII: the long s and the Kelvin sign, which some engines fold to s and k, are other letters.

Defined results: null text counts as empty and has no spans; positions are code points of the whole text; spans of
different kinds may overlap, and of equal starts (ties) the kind listed first comes first; repeated rows are scanned alike; an empty table gives an empty result; other columns,
whatever their names, pass through untouched.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.llm.automaton import Dfa, hits
from lamella.llm.common import importable, lean


class Rule(NamedTuple):
    kind: str
    pattern: str
    #: the group whose length counts (0: the match), and the least number of characters
    group: int = 0
    least: int = 1
    #: what a match takes in besides, where it follows; it may be empty and has no part in finding matches
    tail: str = ""


# A private key behind its header: lines of an encrypted one, then all that a body can hold up to the END line, or without such
# a line the runs of base64 as far as they go, the first of 16 or more; line ends may be spaces or written out as escapes.
BODY = (
    r"([\x20\t\r\n\\rn]*(Proc-Type:\x20*4,ENCRYPTED|DEK-Info:\x20*[A-Z0-9-]+,[A-Fa-f0-9]+))*"
    r"([A-Za-z0-9+/=\x20\t\r\n\\]*-----END\x20[A-Z\x20]*PRIVATE\x20KEY-----|[\x20\t\r\n\\]*[A-Za-z0-9+/=]{16,}([\x20\t\r\n\\]+[A-Za-z0-9+/=]{16,})*([\x20\t\r\n\\]+[A-Za-z0-9+/=]{1,15})?)?"
)
# The three base rules, in their fixed order. A run of hexadecimal digits is matched from 24 on, which
# for a single class equals matching any run and dropping the short ones, and keeps prose from ending matches.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: What the combined automaton adds at no further pass: forge and chat tokens, private keys.
ADDED = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", tail=BODY),
)
RULES = BASE + ADDED
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


@functools.lru_cache(maxsize=4)
def compiled(rules: tuple[Rule, ...]) -> tuple:
    return Dfa([r.pattern for r in rules], False), [(Dfa([r.pattern + r.tail], True), Dfa([r.pattern], True, back=True), re.compile(r.pattern + r.tail, re.A)) for r in rules]


def matches(texts: list[bytes], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """For each text its (byte start, byte end, rule number), by start, then rule."""
    whole, own = compiled(rules)
    out: list[list] = [[] for _ in texts]
    text, pos, bits = hits(whole, texts)
    last, ends = -1, [0] * len(rules)
    for i, p, b in zip(text.tolist(), pos.tolist(), bits.tolist(), strict=True):
        if i != last:
            last, ends = i, [0] * len(rules)
        for k, rule in enumerate(rules):
            if b >> k & 1 and p > ends[k]:
                ahead, back, exact = own[k]
                start = back.earliest(texts[i], p, ends[k])
                if start >= 0:
                    ends[k] = end = ahead.longest(texts[i], start)
                    said = exact.fullmatch(texts[i][start:end].decode("ascii"))
                    if said and len(said[rule.group]) >= rule.least:
                        out[i].append((start, end, k))
    return [sorted(x, key=lambda m: (m[0], m[2])) for x in out]


def points(text: bytes, found: list[tuple]) -> list[tuple]:
    """Byte positions as code points."""
    if not found or text.isascii():
        return found
    before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(int(before[s]), int(before[e]), k) for s, e, k in found]


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def scan(docs: DataFrame, text: str = "text", name: str = "spans", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``name``: an array of (kind, start, end) in code points, end exclusive. A column of that name is replaced."""
    docs = docs.drop(name)
    importable(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch.column(text))
            rows = [[{"kind": rules[k].kind, "start": s, "end": e} for s, e, k in points(t, m)] for t, m in zip(texts, matches(texts, rules), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], [*batch.schema.names, name])

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField(name, SPANS)]))


def redact(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by [SECRET]; overlapping spans become one. Null texts stay null."""
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            column = batch.column(at)
            out = column.cast(pa.binary()).to_pylist()
            for i, found in enumerate(matches([x or b"" for x in out], rules)):
                if found:
                    parts, done = [], 0
                    for s, e, _ in found:
                        if s >= done:
                            parts += [out[i][done:s], b"[SECRET]"]
                        done = max(done, e)
                    out[i] = b"".join([*parts, out[i][done:]])
            clean = pa.array(out, pa.binary()).cast(column.type, safe=False)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], clean, *batch.columns[at + 1 :]], schema=batch.schema)

    return docs.mapInArrow(lean(run), docs.schema)


def digest(found: DataFrame, base: tuple[str, ...] = tuple(r.kind for r in BASE)) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans, and all spans as text."""
    said = "array_join(transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    kinds = ", ".join(f"'{k}'" for k in base)
    return found.select(
        "doc_id",
        *(F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in base),
        F.expr(f"sha2({said.format(f'filter(spans, s -> s.kind IN ({kinds}))')}, 256)").alias("base_sha256"),
        F.expr(said.format("spans")).alias("spans"),
    )
