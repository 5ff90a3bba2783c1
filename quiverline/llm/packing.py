"""Hierarchical multi-length packing.

Documents are tokenized, ended by id 0 and routed by length to tiers of context size.  Whole windows of the longest tier are
cut off long documents; what remains, and short documents, wait in pools, one for each tier.  A window of the long tier
is opened by the longest waiting piece and its gap filled best-fit from the shorter pools, the last of them cut to fit;
then the next tier likewise.  Windows are exactly full, and the few ids left at the end of a partition are cut to powers of two,
so no sequence needs padding.  Sequences are dealt to step groups of equal tokens, each with the same mix of tiers.

A partition is packed by itself, with bounded pools, so packing is one pass without a shuffle; a lost task repeats
its partition and numbers it alike.

Defined results: a null text is an empty one, packed as the single id 0; a null doc_id is packed with a null id;
repeated rows are packed once each; strings of the vocabulary's added tokens in a text become those tokens, as its own
library does by default; very long texts are packed whole; other columns are ignored; an empty table has no sequences.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

TIERS = (1024, 512, 256)
#: Tokens of a step group.
STEP_TOKENS = 1 << 16
#: Waiting ids at which the pools are packed.
POOL_IDS = 1 << 21
_CHARS = 1 << 22
_CACHE = 300_000


#: Path of the ranks, split pattern, path of the same vocabulary's description, which names the added tokens.
Vocabulary = tuple[str, str, str]


def default_vocabulary() -> Vocabulary:
    """The public 50k byte-level BPE."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.json")


class BatchTokenizer:
    """Byte-level BPE over batches: each different blank-led segment is encoded once.

    The split pattern never joins across a blank that a mark or letter follows, so a text may be cut there; texts with
    a blank before white space, or at their end, are encoded in one piece.  Added tokens are cut out first; what stands
    between them is encoded by itself.
    """

    _odd = re.compile(r" (?:\s|$)")

    def __init__(self, vocabulary: Vocabulary):
        import base64
        import json

        import tiktoken

        path, pattern, description = vocabulary
        self.added = {t["content"]: int(t["id"]) for t in json.load(open(description, encoding="utf-8")).get("added_tokens", [])}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for b, i in ranks.items():
            self.width[i] = len(b)
        self._reset()

    def _reset(self) -> None:
        self.cache: dict[str, int] = {}
        self.flat, self.start, self.size = [], [], []
        self.used = 0

    def _add(self, segments: list[str]) -> None:
        """Encode new segments, each led by a blank, in one call and cut the ids at their bounds."""
        text = " " + " ".join(segments)
        ids = np.asarray(self.enc.encode_to_numpy(text, disallowed_special=()) if hasattr(self.enc, "encode_to_numpy") else self.enc.encode_ordinary(text), dtype=np.uint32)
        ends = np.cumsum([len(s.encode()) + 1 for s in segments])
        cut = np.searchsorted(np.cumsum(self.width[ids]), ends, side="left") + 1
        first = len(self.cache)
        self.cache.update(zip(segments, range(first, first + len(segments))))
        self.flat.append(ids)
        self.start.append(self.used + np.concatenate([[0], cut[:-1]]))
        self.size.append(np.diff(cut, prepend=0))
        self.used += len(ids)

    def _with_added(self, text: str) -> np.ndarray:
        parts = [[self.added[p]] if i % 2 else self.enc.encode_ordinary(p) for i, p in enumerate(self._cut.split(text))]
        return np.array([x for p in parts for x in p], dtype=np.uint32)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        split, who = [], []
        for i, t in enumerate(texts):
            t = t or ""
            if any(a in t for a in self.added):
                out[i] = self._with_added(t)
                continue
            head, blank, tail = t.partition(" ")
            if not blank or self._odd.search(t):
                out[i] = np.array(self.enc.encode_ordinary(t), dtype=np.uint32)
            else:
                out[i] = np.array(self.enc.encode_ordinary(head), dtype=np.uint32)
                who.append(i)
                split.append(tail.split(" "))
        if not who:
            return out
        if len(self.cache) > _CACHE:
            self._reset()
        if new := set().union(*split) - self.cache.keys():
            self._add(sorted(new))
        get = self.cache.__getitem__
        at = np.fromiter((x for s in split for x in map(get, s)), dtype=np.int64)
        if len(self.flat) > 1:
            self.flat, self.start, self.size = [np.concatenate(self.flat)], [np.concatenate(self.start)], [np.concatenate(self.size)]
        size = self.size[0][at]
        ends = np.cumsum(size)
        ids = self.flat[0][np.repeat(self.start[0][at] - (ends - size), size) + np.arange(ends[-1])]
        bounds = ends[np.cumsum([len(s) for s in split]) - 1]
        for i, part in zip(who, np.split(ids, bounds[:-1])):
            out[i] = np.concatenate([out[i], part])
        return out


class Packer:
    """Packs one partition's documents; `rows` holds finished pieces."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, base: int = 0):
        self.tiers, self.step_tokens = tiers, step_tokens
        self.next, self.steps = base, base
        self.waiting: list[tuple[int, int, object, np.ndarray, int]] = []  # (length, order, doc_id, ids of the whole document, start)
        self.held = self.order = 0
        self.rows: list[tuple] = []
        self.fresh: list[tuple[int, int, list]] = []  # (sequence, padded length, pieces)

    def _sequence(self, pieces: list[tuple[int, int, object, np.ndarray, int]]) -> None:
        n = sum(p[0] for p in pieces)
        self.fresh.append((self.next, n if n & (n - 1) == 0 else self.tiers[0], pieces))
        self.next += 1

    def add(self, doc_id: object, ids: np.ndarray) -> None:
        top, n = self.tiers[0], len(ids)
        whole = n // top * top
        for at in range(0, whole, top):
            self._sequence([(top, 0, doc_id, ids, at)])
        if n > whole:
            self.waiting.append((n - whole, self.order, doc_id, ids, whole))
            self.order += 1
            self.held += n - whole
        if self.held >= POOL_IDS:
            self.pack(False)

    def pack(self, last: bool) -> None:
        """Fill windows tier by tier from the waiting pieces; unless `last`, what fills no window waits on."""
        pool = sorted(self.waiting, key=lambda p: p[:2])
        self.waiting, self.held = [], 0
        total = sum(p[0] for p in pool)
        for tier in self.tiers:
            # pieces longer than the next tier open windows of this one; the last tier takes all the rest
            least = tier // 2 if tier != self.tiers[-1] else 0
            while pool and total >= tier and pool[-1][0] > least:
                pieces, gap = [], tier
                while gap:
                    k = bisect_right(pool, gap, key=lambda p: p[0]) - 1
                    if k >= 0:
                        piece = pool.pop(k)
                    else:  # the shortest piece is longer than the gap: cut it
                        n, order, doc, ids, at = pool.pop(0)
                        piece = (gap, order, doc, ids, at)
                        insort(pool, (n - gap, order, doc, ids, at + gap), key=lambda p: p[:2])
                    pieces.append(piece)
                    gap -= piece[0]
                    total -= piece[0]
                self._sequence(pieces)
        if last:
            while total:
                size = 1 << (total.bit_length() - 1)
                pieces, gap = [], size
                while gap:
                    n, order, doc, ids, at = pool.pop()
                    take = min(n, gap)
                    pieces.append((take, order, doc, ids, at))
                    if n > take:
                        pool.append((n - take, order, doc, ids, at + take))
                    gap -= take
                total -= size
                self._sequence(pieces)
        else:
            self.waiting, self.held = pool, total
        self._settle()

    def _settle(self) -> None:
        """Deal fresh sequences to step groups: tiers in proportion along the order, cut where the tokens are full."""
        by: dict[int, int] = {}
        for _, size, _ in self.fresh:
            by[size] = by.get(size, 0) + 1
        nth: dict[int, int] = {}
        order = []
        for seq, size, pieces in self.fresh:
            nth[size] = nth.get(size, 0) + 1
            order.append(((nth[size] - 0.5) / by[size], seq, size, pieces))
        tokens = 0
        for _, seq, size, pieces in sorted(order, key=lambda x: x[:2]):
            offset = 0
            step = self.steps + tokens // self.step_tokens
            tokens += size
            for n, _, doc, ids, at in pieces:
                crc = zlib.crc32(ids[at : at + n].astype("<u4").tobytes())
                self.rows.append((doc, at, n, crc, len(ids), seq, offset, size, step))
                offset += n
        self.steps += -(-tokens // self.step_tokens)
        self.fresh = []


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, context_size long, step_group long"


def text_blocks(texts: pd.Series, chars: int = _CHARS) -> Iterator[tuple[int, int]]:
    size, lo = 0, 0
    for i, t in enumerate(texts):
        size += len(t) if isinstance(t, str) else 0
        if size >= chars:
            yield lo, i + 1
            size, lo = 0, i + 1
    if lo < len(texts):
        yield lo, len(texts)


def pack(docs: DataFrame, vocabulary: Vocabulary | None = None, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """One row per piece; `context_size` is the sequence's padded length, `step_group` its training step group."""
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok, packer = BatchTokenizer(vocabulary), Packer(tiers, base=TaskContext.get().partitionId() << 40)

        def out() -> pd.DataFrame:
            rows, packer.rows = packer.rows, []
            df = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            df["doc_id"] = df["doc_id"].astype("Int64")
            return df

        end = np.zeros(1, dtype=np.uint32)
        for b in batches:
            ids = [None if pd.isna(x) else int(x) for x in b["doc_id"]]
            for lo, hi in text_blocks(b["text"]):
                for doc, x in zip(ids[lo:hi], tok.encode([t if isinstance(t, str) else None for t in b["text"].iloc[lo:hi]])):
                    packer.add(doc, np.concatenate([x, end]))
                if len(packer.fresh) > 4096:
                    packer._settle()
                if packer.rows:
                    yield out()
        packer.pack(True)
        if packer.rows:
            yield out()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInPandas(run, SCHEMA)
