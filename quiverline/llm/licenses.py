"""License scan: base phrases plus ordered signature rules.

Method: several hundred hand-written regular expressions (`license_rules`), each gated by keywords of which one must occur
in the text, each with a priority of its own.  Detections are taken in order of priority; one that lies inside an accepted
interval is suppressed.  The three base phrases are matched apart from the rules and always stay.

Defined results: a null text is an empty one; an empty text has no words, no labels and score 0; a very long text is
scanned whole, in time that grows with its length and its detections; an empty table gives an empty result; repeated rows
give repeated results; a null doc_id stays null; other input columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import license_rules

#: Base phrases and their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

_SEP = bytes(x for x in range(0x80) if not (0x30 <= x <= 0x39 or 0x41 <= x <= 0x5A or 0x61 <= x <= 0x7A))
_TABLE = bytes(ord(" ") if bytes([x]) in _SEP else (x + 32 if 0x41 <= x <= 0x5A else x) for x in range(256))


def normal(text: str | None) -> bytes:
    """The words of a text, lower-cased (A-Z) and joined by single spaces, as UTF-8."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split())


@lru_cache(1)
def rules() -> list[tuple[str, re.Pattern, float]]:
    """(label, expression over whole words, confidence), in order of priority."""
    return [(label, re.compile(rb"(?:(?<= )|^)(?:" + expression.encode() + rb")(?= |$)"), confidence) for label, confidence, _, expression in license_rules.parsed()]


@lru_cache(1)
def keywords() -> ahocorasick.Automaton:
    """All keywords in one automaton, each with the rules that it gates."""
    by: dict[str, set[int]] = {}
    for i, (_, _, keys, _) in enumerate(license_rules.parsed()):
        for k in keys:
            by.setdefault(k.strip(), set()).add(i)
    out = ahocorasick.Automaton()
    for k, ids in by.items():
        out.add_word(k, frozenset(ids))
    out.make_automaton()
    return out


def base_places(norm: bytes) -> list[tuple[int, int, str]]:
    """(start, end, label), in characters of the normal form, of every place of a base phrase."""
    out = []
    for phrase, label in BASE:
        p, at = phrase.encode(), -1
        while (at := norm.find(p, at + 1)) >= 0:
            end = at + len(p)
            if (at == 0 or norm[at - 1] == 32) and (end == len(norm) or norm[end] == 32):
                out.append((at, end, label))
    return out


def rule_places(norm: bytes) -> list[tuple[int, int, str, float]]:
    """Accepted detections of the rules, in order of priority: none lies inside an accepted one."""
    gates = {ids for _, ids in keywords().iter(norm.decode("latin-1"))}
    todo = sorted(set().union(*gates))
    # from each place that accepted intervals cover, how far they reach
    reach = np.zeros(len(norm) if todo else 0, dtype=np.int64)
    kept: list[tuple[int, int, str, float]] = []
    for i in todo:
        label, expression, confidence = rules()[i]
        # a rule's own matches don't overlap, so they can be taken together
        spans = np.array([m.span() for m in expression.finditer(norm)], dtype=np.int64).reshape(-1, 2)
        spans = spans[reach[spans[:, 0]] < spans[:, 1]]
        size = spans[:, 1] - spans[:, 0]
        at = np.repeat(spans[:, 1] - np.cumsum(size), size) + np.arange(size.sum())
        reach[at] = np.maximum(reach[at], np.repeat(spans[:, 1], size))
        kept += [(a, b, label, confidence) for a, b in spans.tolist()]
    return kept


def scan_text(text: str | None) -> tuple:
    norm = normal(text)
    n = norm.count(b" ") + 1 if norm else 0
    base, more = base_places(norm), rule_places(norm)
    starts, spans = [], []
    if base or more:
        blanks = np.flatnonzero(np.frombuffer(norm, dtype=np.uint8) == 32)
        starts = np.searchsorted(blanks, [a for a, _, _ in base]).tolist()
        first, last = (np.searchsorted(blanks, [x[k] for x in more]).tolist() for k in (0, 1))
        spans = [(a, b + 1, label, conf) for a, b, (_, _, label, conf) in zip(first, last, more)]
    labels = {x[2] for x in base}
    score = max([0.0] + [1.0] * bool(base) + [x[3] for x in more])
    return (
        n, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)),
        ",".join(sorted(labels | {x[2] for x in more})), score, spans,
    )


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "detections array<struct<first_word:long,end_word:long,label:string,confidence:double>>"
)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per document: the base columns, `labels` with the rules' own, and `detections` as word intervals."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [scan_text(t) for t in b["text"]]
            cols = list(zip(*rows)) or [[] for _ in range(8)]
            out = pd.DataFrame({"doc_id": b["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None)})
            for k, name in enumerate(("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")):
                out[name] = pd.Series(cols[k], dtype="Int64" if k < 4 else None)
            out["detections"] = [[dict(zip(("first_word", "end_word", "label", "confidence"), s)) for s in x] for x in cols[7]]
            yield out

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInPandas(run, SCHEMA)
