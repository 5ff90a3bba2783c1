"""SentencePiece encoding and decoding by suffix-array matching.

Texts are cut where no piece can reach across (before a blank mark that follows another character, and around
characters of no piece), and the different segments of a batch are concatenated.  A suffix array over that text, sorted as
deep as the longest piece, is binary-searched for the range of every piece of the vocabulary; the ranges are the
edges of the lattice.  Sorted by where they end, they are relaxed from left to right, all segments at once.

The vocabulary is a byte-pair model, so an edge relaxes on to a place if the piece and the one before it are
compatible: if encoding both together would leave the border between them alone.  One edge does at every place, and
the path back is exactly the library's encoding.  Whether two pieces are compatible follows from their merge
histories: a merge across the border must come up before either side's next one.

Defined results: a null or empty text has no ids; a blank mark in the input counts as a blank; characters of no piece
become their UTF-8 bytes' pieces; decoding replaces broken byte runs; repeated rows are encoded alike; a null doc_id stays
null; long texts are handled whole; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .packing import text_blocks

MARK = "▁"
_CHARS = 3 << 20
_MEMO = 1 << 22


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _merges(chars: list[str], rank: dict[str, int]) -> tuple[list[tuple[int, int, int]], list[str]]:
    """((place, rank, length after) of each merge in order, final pieces): best rank first, then leftmost."""
    n = len(chars)
    sym, nxt, prv, heap = list(chars), [*range(1, n), -1], [-1, *range(n - 1)], []

    def offer(i: int) -> None:
        if i >= 0 and nxt[i] >= 0 and (r := rank.get(sym[i] + sym[nxt[i]])) is not None:
            heappush(heap, (r, i, sym[i], sym[nxt[i]]))

    for i in range(n - 1):
        offer(i)
    done = []
    while heap:
        r, i, a, b = heappop(heap)
        if sym[i] != a or nxt[i] < 0 or sym[nxt[i]] != b:
            continue
        j = nxt[i]
        sym[i], sym[j] = a + b, ""
        nxt[i] = nxt[j]
        if nxt[j] >= 0:
            prv[nxt[j]] = i
        done.append((i, r, len(a + b)))
        offer(prv[i])
        offer(i)
    return done, [s for s in sym if s]


class Vocabulary:
    """Pieces, and for each the history of its outermost symbols while it is merged."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        if sp.normalize(" a  b") != f"{MARK}{MARK}a{MARK}{MARK}b":
            raise ValueError("only models that keep blanks, add one in front and normalize nothing are supported")
        self.names = [sp.id_to_piece(i) for i in range(n)]
        self.bytes_of = {int(self.names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        if any(re.search(f"[^{MARK}]{MARK}", self.names[i]) for i in plain):
            raise ValueError("a piece holds a blank mark after another character")
        self.id_of = {self.names[i]: i for i in plain}
        self.single = {p for p in self.id_of if len(p) == 1}
        self.longest = max(map(len, self.id_of))
        by_score = sorted(plain, key=lambda i: -sp.get_score(i))
        level, self.rank, last = 0, {}, None
        for i in by_score:
            level += sp.get_score(i) != last
            last = sp.get_score(i)
            self.rank[self.names[i]] = level
        self._histories(n)
        # what decoding writes for each id
        raw = [b""] * n
        for p, i in self.id_of.items():
            raw[i] = p.replace(MARK, " ").encode()
        for b, i in self.bytes_of.items():
            raw[i] = bytes([b])
        self.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.raw_size = np.array([len(x) for x in raw], dtype=np.int64)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size

    def _histories(self, n: int) -> None:
        """right[t, k], left[t, k]: the outermost symbol's id at its k-th state, and when that ends (time of the merge that takes it)."""
        never = np.int64(1) << 60
        rights: dict[int, list] = {}
        lefts: dict[int, list] = {}
        self.reachable = np.zeros(n, dtype=bool)
        for p, i in self.id_of.items():
            if not set(p) <= self.single:
                continue
            done, final = _merges(list(p), self.rank)
            if final != [p]:
                continue
            self.reachable[i] = True
            now, rl, ll = 0, [(p[-1], 0)], [(p[0], 0)]
            for at, r, size in done:
                now = max(now, r)
                when = (now << 20) | r
                if at + size == len(p):
                    rl.append((p[at:], when))
                if at == 0:
                    ll.append((p[:size], when))
            for got, seq in ((rights, rl), (lefts, ll)):
                got[i] = [(self.id_of[s], seq[k + 1][1] if k + 1 < len(seq) else int(never)) for k, (s, _) in enumerate(seq)]
        depth = max(len(x) for d in (rights, lefts) for x in d.values())
        self.right = np.zeros((n, depth, 2), dtype=np.int64)
        self.left = np.zeros((n, depth, 2), dtype=np.int64)
        for got, table in ((rights, self.right), (lefts, self.left)):
            table[:, :, 1] = never
            for i, x in got.items():
                table[i, : len(x)] = x
        keys, ranks = [], []
        for p in self.id_of:
            for k in range(1, len(p)):
                a, b = self.id_of.get(p[:k]), self.id_of.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b)
                    ranks.append(self.rank[p])
        order = np.argsort(keys)
        self.pair_key, self.pair_rank = np.array(keys, dtype=np.int64)[order], np.array(ranks, dtype=np.int64)[order]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether encoding the two pieces together leaves the border between them."""
        ok = np.ones(len(a), dtype=bool)
        i, j = np.zeros(len(a), dtype=np.int64), np.zeros(len(a), dtype=np.int64)
        since = np.zeros(len(a), dtype=np.int64)  # when both present symbols were there
        live = np.arange(len(a))
        never = np.int64(1) << 60
        while len(live):
            x, y = self.right[a[live], i[live]], self.left[b[live], j[live]]
            key = x[:, 0] << 20 | y[:, 0]
            k = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            r = np.where(self.pair_key[k] == key, self.pair_rank[k], np.int64(1) << 39)
            when = np.maximum(since[live] >> 20, r) << 20 | r
            ok[live[(r < 1 << 39) & (when < x[:, 1]) & (when <= y[:, 1])]] = False
            left_first = x[:, 1] <= y[:, 1]
            ends = np.minimum(x[:, 1], y[:, 1])
            go = ok[live] & (ends < never)
            live, left_first, ends = live[go], left_first[go], ends[go]
            since[live] = np.maximum(since[live], ends)
            i[live[left_first]] += 1
            j[live[~left_first]] += 1
        return ok


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes batches of texts."""

    def __init__(self, path: str):
        self.v = v = vocabulary(path)
        self.memo_key = np.full(_MEMO, -1, dtype=np.int64)
        self.memo_ok = np.zeros(_MEMO, dtype=bool)
        chars = sorted({c for p in v.id_of for c in p if v.reachable[v.id_of[p]]})
        self.known = np.zeros(0x110000, dtype=np.int32)
        self.known[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        other = "".join(re.escape(c) for c in chars)
        self.cut = re.compile(f"{MARK}+[^{MARK}]*")
        self.stray = re.compile(f"([^{other}])")
        ids = np.flatnonzero(v.reachable)
        self.piece_ids = ids
        self.piece_chars = np.zeros((len(ids), v.longest), dtype=np.int32)
        self.piece_len = np.array([len(v.names[i]) for i in ids])
        for row, i in enumerate(ids):
            self.piece_chars[row, : self.piece_len[row]] = [self.known[ord(c)] for c in v.names[i]]

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 20 | b
        slot = (key * np.int64(0x9E3779B97F4A7C1) >> 20) & (_MEMO - 1)
        miss = np.flatnonzero(self.memo_key[slot] != key)
        ok = self.memo_ok[slot]
        if len(miss):
            new, back = np.unique(key[miss], return_inverse=True)
            val = self.v.compatible(new >> 20, new & 0xFFFFF)
            ok[miss] = val[back]
            self.memo_key[slot[miss]], self.memo_ok[slot[miss]] = key[miss], ok[miss]
        return ok

    def edges(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, piece row) of every occurrence of a piece in `flat` (classes of characters, 0 between segments)."""
        used = np.zeros(self.known.max() + 1, dtype=bool)
        used[flat] = True
        used[0] = True
        small = np.cumsum(used) - 1  # ordered classes of this batch only, so that more fit a word
        bits = max(1, int(small[-1]).bit_length())
        per = 63 // bits
        depth = -(-self.v.longest // per)
        text = np.concatenate([small[flat], np.zeros(per * depth, dtype=np.int64)])
        n = len(flat)
        word = np.zeros(len(text) - per + 1, dtype=np.int64)
        for k in range(per):
            word = word << bits | text[k : k + len(word)]
        keys = [word[d * per : d * per + n] for d in range(depth)]
        order = np.argsort(keys[0])
        for d in range(1, depth):  # sort on among suffixes whose words so far agree
            same = np.ones(n - 1, dtype=bool) if n else np.ones(0, dtype=bool)
            for e in range(d):
                s = keys[e][order]
                same &= s[1:] == s[:-1]
            tied = np.zeros(n, dtype=bool)
            tied[1:] |= same
            tied[:-1] |= same
            tied &= (keys[d - 1][order] & ((1 << bits) - 1)) != 0  # words that end a segment are settled
            at = np.flatnonzero(tied)
            part = order[at]
            order[at] = part[np.lexsort([keys[e][part] for e in range(d, -1, -1)])]
        possible = used[self.piece_chars].all(1)
        rows = np.flatnonzero(possible)
        pc = np.where(np.arange(self.v.longest) < self.piece_len[rows, None], small[self.piece_chars[rows]], -1)
        pc = np.concatenate([pc, np.full((len(rows), per * depth - self.v.longest), -1, dtype=np.int64)], axis=1) if per * depth > self.v.longest else pc
        lows, highs, top = [], [], (1 << bits) - 1
        for d in range(depth):
            lo, hi = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
            for k in range(d * per, (d + 1) * per):
                c = pc[:, k]
                lo, hi = lo << bits | np.where(c < 0, 0, c), hi << bits | np.where(c < 0, top, c)
            lows.append(lo)
            highs.append(hi)
        sorted_keys = [k[order] for k in keys]
        first = np.searchsorted(sorted_keys[0], lows[0], side="left")
        last = np.searchsorted(sorted_keys[0], highs[0], side="right")
        for d in range(1, depth):
            for r in np.flatnonzero((self.piece_len[rows] > d * per) & (last > first)):
                a, b = first[r], last[r]
                part = sorted_keys[d][a:b]
                first[r], last[r] = a + np.searchsorted(part, lows[d][r], side="left"), a + np.searchsorted(part, highs[d][r], side="right")
        size = np.maximum(last - first, 0)
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        start = order[np.repeat(first - (ends - size), size) + np.arange(total)].astype(np.int32)
        return start, np.repeat(rows.astype(np.int32), size)

    def segments(self, segs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, size) of the encodings of the segments, none of which holds a stray character."""
        if not segs:
            none = np.empty(0, dtype=np.int64)
            return none, none, none
        joined = "\0".join(segs) + "\0"
        flat = self.known[np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)]
        size = np.array([len(s) for s in segs])
        begin = np.cumsum(size + 1) - size - 1
        start, row = self.edges(flat)
        seg_of = np.repeat(np.arange(len(segs)), size + 1)
        end_rel = start + self.piece_len[row] - begin[seg_of[start]]  # characters of the segment up to the edge's end
        order = np.argsort(end_rel.astype(np.uint16) if size.max() < 65536 else end_rel, kind="stable")
        start, row, end_rel = start[order], row[order], end_rel[order]
        first = start == begin[seg_of[start]]
        piece = self.piece_ids[row]
        bounds = np.searchsorted(end_rel, np.arange(1, int(size.max()) + 2))
        last = np.full(len(flat), -1, dtype=np.int64)
        count = np.zeros(len(flat), dtype=np.int64)
        back = np.zeros(len(flat), dtype=np.int64)
        for a, b in zip(bounds[:-1], bounds[1:]):
            if a == b:
                continue
            s, p, f = start[a:b], piece[a:b], first[a:b]
            prev = np.where(f, -1, last[np.maximum(s - 1, 0)])
            ok = f.copy()
            try_ = np.flatnonzero(~f & (prev >= 0))
            ok[try_] = self._compatible(prev[try_], p[try_])
            s, p, f = s[ok], p[ok], f[ok]
            e = s + self.piece_len[row[a:b][ok]] - 1
            last[e] = p
            count[e] = np.where(f, 0, count[np.maximum(s - 1, 0)]) + 1
            back[e] = s - 1
        finish = begin + size - 1
        n_ids = count[finish]
        out_end = np.cumsum(n_ids)
        out_start = out_end - n_ids
        out = np.zeros(int(out_end[-1]), dtype=np.int64)
        at, to, left = finish.copy(), out_end - 1, n_ids.copy()
        while len(at):
            out[to] = last[at]
            at, to, left = back[at], to - 1, left - 1
            go = left > 0
            at, to, left = at[go], to[go], left[go]
        return out, out_start, n_ids

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        split = []
        for t in texts:
            if not t:
                split.append([])
            elif "  " in t or MARK in t or t[0] == " " or t[-1] == " ":
                split.append(self.cut.findall(MARK + t.replace(" ", MARK)))
            else:
                split.append((MARK + t.replace(" ", " " + MARK)).split(" "))
        different = list(set().union(*split))
        get = dict(zip(different, range(len(different)))).__getitem__
        # cut the few segments that hold stray characters around them
        stray = {k: [x for x in self.stray.split(s) if x] for k, s in enumerate(different) if self.stray.search(s)}
        whole = [s for k, s in enumerate(different) if k not in stray]
        inner = list({x for parts in stray.values() for x in parts if not self.stray.match(x)})
        ids, start, size = self.segments(whole + inner)
        seg_start, seg_size = np.zeros(len(different), dtype=np.int64), np.zeros(len(different), dtype=np.int64)
        at = np.ones(len(different), dtype=bool)
        at[list(stray)] = False
        seg_start[at], seg_size[at] = start[: len(whole)], size[: len(whole)]
        where = dict(zip(inner, zip(start[len(whole) :].tolist(), size[len(whole) :].tolist())))
        pool, n = [ids], len(ids)
        for k, parts in stray.items():
            got = []
            for x in parts:
                if x in where:
                    a, m = where[x]
                    got.append(ids[a : a + m])
                else:
                    got.append(np.array([self.v.bytes_of.get(c, self.v.unknown) for c in x.encode("utf-8", "replace")], dtype=np.int64))
            pool += got
            seg_start[k], seg_size[k] = n, sum(map(len, got))
            n += int(seg_size[k])
        ids = np.concatenate(pool)
        per_doc = (np.fromiter(map(get, segs), dtype=np.int64, count=len(segs)) for segs in split)
        return [_gather(ids, seg_start[d], seg_size[d]).astype(np.int32) for d in per_doc]

    def decode(self, ids: np.ndarray) -> str:
        v = self.v
        raw = _gather(v.raw, v.raw_start[ids], v.raw_size[ids]).tobytes()
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Concatenation of the runs flat[start : start + size]."""
    if not len(start):
        return flat[:0]
    ends = np.cumsum(size)
    return flat[np.repeat(start - (ends - size), size) + np.arange(ends[-1])]


def encode(docs: DataFrame, model: str | None = None, keep_ids: bool = True) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, round_trip[, ids]): `round_trip` says that decoding gives the text back (blank marks as blanks)."""
    model = model or default_model()
    schema = "doc_id long, n_ids long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = Encoder(model)
        for b in batches:
            for lo, hi in text_blocks(b["text"], _CHARS):
                texts = [t if isinstance(t, str) else None for t in b["text"].iloc[lo:hi]]
                got = enc.encode(texts)
                out = pd.DataFrame({"doc_id": b["doc_id"].iloc[lo:hi].astype("Int64").to_numpy(dtype=object, na_value=None)})
                out["n_ids"] = [len(x) for x in got]
                out["ids_crc32"] = [zlib.crc32(x.astype("<u4").tobytes()) for x in got]
                out["round_trip"] = [enc.decode(x) == (t or "").replace(MARK, " ") for x, t in zip(got, texts)]
                if keep_ids:
                    out["ids"] = [x.tolist() for x in got]
                yield out

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInPandas(run, schema)


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give a null text."""
    model = model or default_model()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = Encoder(model)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None), "text": [None if x is None else enc.decode(np.asarray(x, dtype=np.int64)) for x in b["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")
