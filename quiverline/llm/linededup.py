"""Line deduplication by an exact set-similarity join, in DataFrame functions only.

A line is the set of its lower-cased words.  Its tokens are ordered from rare to frequent; two lines whose sets have a Jaccard
similarity of at least 4/5 share a token within their prefixes, which rules of length and place make short, must be of
similar length, must have room for enough shared tokens behind the first one, and can differ in few bits of their parity
words.  Pairs that pass these filters are verified on the whole sets.  A line goes if any earlier line (by doc_id, then
place) has the same set or a similar one.

Rarity is the number of times that the token's bucket (of 131,072) occurs in the different lines of all documents: a table of
fixed size whatever the vocabulary, in classes of half a power of two, and a total order with the token's hash behind it, so
the join is exact.  Lines of equal text are one throughout.  In a large group of variants every line would meet every other, so lines first
meet the earliest line of each of their rare tokens; only lines that this leaves alone go on to meet all earlier ones.

Defined results: a null or empty text stays as it is; blank lines stay and match nothing; rows with a null doc_id stay
whole and match nothing; rows that repeat a doc_id count as the same document, and keep what it keeps: a place stays in
all of them if the line of any stays; a document
whose lines all go has an empty text and stays; an empty table gives an empty result; lines and texts of any length are
taken whole; other columns are ignored, or kept as they are by `rewrite`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_tables, materialise

_BUCKET_BITS = 17
BUCKETS = 1 << _BUCKET_BITS
#: Turns that the tokens are joined in, with the earliest lines and with all.
PIVOT_TURNS, PAIR_TURNS = 1, 2
#: Words from which on a line has two parity words of 64 bits instead of one, and four instead of two.
LONG, LONGER = 80, 160
#: Rows of one long that are broadcast at most; beyond, they are joined by a shuffle.
BROADCAST_IDS = 1 << 20
#: Bits of a token's place in the order that are its rarity's class.
_CLASS_BITS = 6
_WORDS = ["w0", "w1", "w2", "w3"]


def _set(low: Column) -> Column:
    """The different tokens of a lower-cased line, which stand between white space: hashes of 63 bits."""

    def token(t: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(t), 1)

    odd = F.contains(low, F.lit("\t")) | F.contains(low, F.lit("\r")) | F.contains(low, F.lit("\x0b")) | F.contains(low, F.lit("\x0c"))
    words = F.split(F.when(odd, F.translate(low, "\t\r\x0b\x0c", "    ")).otherwise(low), " ")
    # between blanks that follow each other stands nothing
    return F.array_remove(F.array_distinct(F.transform(words, token)), token(F.lit("")))


def _bucket(token: Column) -> Column:
    """0 to BUCKETS - 1, from the token's highest bits."""
    return F.shiftrightunsigned(token, 63 - _BUCKET_BITS).cast("int")


class _Places:
    """Longs that order lines by doc_id, then place: `key << bits | place`, the key being the id where it fits, else its rank."""

    def __init__(self, docs: DataFrame):
        # a text has fewer line breaks than bytes
        most, low, high = docs.agg(F.max(F.octet_length("text")), F.min("doc_id"), F.max("doc_id")).first()
        self.bits = max(1, int((most or 0) + 1).bit_length())
        self.ranked = None
        if low is None or (low >= 0 and int(high).bit_length() + self.bits <= 62):
            return
        ids = docs.where("doc_id IS NOT NULL").select("doc_id").distinct()
        placed = materialise(ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id").withColumn("row", F.monotonically_increasing_id()), "line-ids")
        part, row = F.shiftright("row", 33), F.col("row").bitwiseAND(F.lit((1 << 33) - 1))
        # a row for each partition of the sort
        first = placed.groupBy(part.alias("part")).count()
        first = first.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
        self.ranked = placed.withColumn("part", part).join(F.broadcast(first), "part").select("doc_id", (F.col("before") + row).alias("key"))

    def keyed(self, docs: DataFrame) -> DataFrame:
        """`docs`, which has a long `doc_id`, with `key`."""
        return docs.withColumn("key", F.col("doc_id")) if self.ranked is None else docs.join(self.ranked, "doc_id", "left")


def _blank(line: Column) -> Column:
    return F.ltrim(line, F.lit(" \t\r\x0b\x0c")) == ""


def line_table(docs: DataFrame, places: _Places) -> DataFrame:
    """(seq, r) of the different lines of all documents that aren't blank: the first place and the token set.

    Lines are the same here if their lower-cased text is.
    """
    lines = places.keyed(docs).where("key IS NOT NULL AND text IS NOT NULL").select("key", F.posexplode(F.split("text", "\n")).alias("place", "line")).where(~_blank(F.col("line")))
    lines = lines.select(F.lower("line").alias("low"), F.shiftleft("key", places.bits).bitwiseOR(F.col("place").cast("long")).alias("seq"))
    # the text is the key: as a value it would need sorted aggregation
    return lines.groupBy("low").agg(F.min("seq").alias("seq")).select("seq", _set(F.col("low")).alias("r"))


def rarity(lines: DataFrame) -> list[int]:
    """For each bucket, the class of how often its tokens occur in the different lines: twice the logarithm, to the base of 2."""
    counts = lines.select(F.explode("r").alias("t")).groupBy(_bucket(F.col("t")).alias("b")).count()
    out = [0] * BUCKETS
    # a row for each bucket at most
    for r in counts.select("b", F.least(F.floor(2 * F.log2("count")), F.lit((1 << _CLASS_BITS) - 1)).cast("int").alias("c")).collect():
        out[r["b"]] = r["c"]
    return out


def _heads(lines: DataFrame, classes: list[int]) -> DataFrame:
    """(seq, n, w0..w3, head): the prefix of each line's set, rarest first, and its parity words.

    A token sets or clears one bit of the words, so each bit in which two lines' words differ is a token that only one has.  All lines
    have the parity of all tokens in 64 bits, w0; long lines have that of half of them besides, w1, and longer ones that of a quarter
    in w2 and of another in w3; words that a line lacks are null.  Sets of fewer than four words are similar to none but themselves,
    so their whole set is their one token.
    """
    # a constant that Spark folds into one array
    table = F.split(F.lit(",".join(map(str, classes))), ",").cast("array<tinyint>")

    def ranked(t: Column) -> Column:
        kind = F.shiftleft(F.get(table, _bucket(t)).cast("long"), 63 - _CLASS_BITS)
        # never null, and said to be so: arrays that may hold nulls are sorted as objects
        return F.coalesce(kind.bitwiseOR(F.shiftrightunsigned(t, _CLASS_BITS)), F.lit(0).cast("long"))

    n = F.size("r")
    whole = F.array(F.xxhash64(F.sort_array("r")).bitwiseOR(F.lit(-(1 << 63))))
    head = F.when(n < 4, whole).otherwise(F.slice(F.sort_array(F.transform("r", ranked)), F.lit(1), (n / 5).cast("int") + 1))
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")

    def flipped(a: Column, t: Column) -> Column:
        return a.bitwiseXOR(F.call_function("shiftleft", one, t.bitwiseAND(F.lit(63).cast("long")).cast("int")))

    def word(mask: int, bits: int) -> Column:
        """Parity of the tokens that have these bits under the mask."""
        return F.aggregate("r", zero, lambda a, t: F.when(t.bitwiseAND(F.lit(mask).cast("long")) == bits, flipped(a, t)).otherwise(a))

    words = [F.aggregate("r", zero, flipped), F.when(n >= LONG, word(64, 64)), F.when(n >= LONGER, word(192, 128)), F.when(n >= LONGER, word(192, 192))]
    return lines.select("seq", n.alias("n"), *(x.alias(name) for x, name in zip(words, _WORDS)), head.alias("head"))


def _apart(words: list[tuple[Column, Column]]) -> Column:
    """Bits in which two lines' words differ, in as many words as both have: a lower bound of the tokens that only one of them has."""
    w = [a.bitwiseXOR(b) for a, b in words]
    parts = [[w[0]], [w[0].bitwiseXOR(w[1]), w[1]]]
    if len(w) == 4:
        parts.append([w[0].bitwiseXOR(w[1]).bitwiseXOR(w[2]), w[1].bitwiseXOR(w[3]), w[2], w[3]])
    # null where a line lacks a word
    return F.coalesce(*(reduce(Column.__add__, map(F.bit_count, p)) for p in reversed(parts)))


def _turn(rows: DataFrame, turn: int, turns: int) -> DataFrame:
    """Rows of the tokens that fall to a turn; their lowest bits are a hash's."""
    return rows.where(F.pmod("token", F.lit(turns)) == turn)


def _short(n: str) -> Column:
    """Tokens of the shorter line's prefix."""
    return F.floor(F.col(n) / 9).cast("int") + 1


def _to_pivots(heads: DataFrame, turn: int) -> DataFrame:
    """(x, y): lines y and the earliest line x of each token of their short prefix, if length and parity allow them to be similar."""
    rare = _turn(heads.select("seq", "n", "w0", "w1", F.explode(F.slice("head", F.lit(1), _short("n"))).alias("token")), turn, PIVOT_TURNS)
    # in order, so that each row sees its token's first one: neither a second reading of the prefixes nor a join
    before = Window.partitionBy("token").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = rare.select("seq", "n", "w0", "w1", *(F.first(c).over(before).alias(x) for c, x in (("seq", "x"), ("n", "xn"), ("w0", "xw0"), ("w1", "xw1"))))
    alike = _apart([(F.col("w0"), F.col("xw0")), (F.col("w1"), F.col("xw1"))]) * 9 <= F.col("n") + F.col("xn")
    met = met.where((F.col("seq") > F.col("x")) & (F.col("xn") * 5 >= F.col("n") * 4) & (F.col("n") * 5 >= F.col("xn") * 4) & alike)
    return met.select("x", F.col("seq").alias("y")).distinct()


def _pairs(heads: DataFrame, turn: int) -> DataFrame:
    """(x, y), x before y and y `alone`, from `heads(seq, n, w0..w3, head, alone)`, by the tokens of one turn.

    A shorter line s and a longer one l of at most 5/4 of its length need an overlap of 4/9 of both lengths, which is at least 8/9
    of s and 4/5 of l; so a token of the first |s| / 9 + 1 of s is among the first |l| / 5 + 1 of l.  In the join: lengths;
    places, as the overlap is at most the rest of either line behind the first token that they share; and parity.
    """
    kind = F.shiftleft("n", 1).bitwiseOR(F.col("alone").cast("int"))

    def side(name: str, tokens: Column) -> DataFrame:
        words = [F.col(w).alias(f"{name}{w}") for w in _WORDS]
        return _turn(heads.select(F.col("seq").alias(name), kind.alias(f"{name}k"), *words, F.posexplode(tokens).alias(f"{name}p", "token")), turn, PAIR_TURNS)

    s, l = side("s", F.slice("head", F.lit(1), _short("n"))), side("l", F.col("head"))
    sn, ln = F.shiftright("sk", 1), F.shiftright("lk", 1)
    first = (sn < ln) | ((sn == ln) & (F.col("s") < F.col("l")))
    alone = F.when(F.col("s") < F.col("l"), F.col("lk")).otherwise(F.col("sk")).bitwiseAND(F.lit(1)) == 1
    room = F.least(sn - F.col("sp"), ln - F.col("lp")) * 9 >= (sn + ln) * 4
    alike = _apart([(F.col(f"s{w}"), F.col(f"l{w}")) for w in _WORDS]) * 9 <= sn + ln
    met = s.join(l, "token").where((sn * 5 >= ln * 4) & first & alike & alone & room)
    return met.select(F.least("s", "l").alias("x"), F.greatest("s", "l").alias("y")).distinct()


def _few(ids: DataFrame) -> bool:
    """Whether a table of one long is small enough to be broadcast."""
    return ids.count() <= BROADCAST_IDS


def _verified(pairs: DataFrame, lines: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(`y` of the pairs (x, y) whose whole sets have a Jaccard similarity of at least 4/5, tables it reads)."""
    ids = materialise(pairs.select(F.explode(F.array("x", "y")).alias("seq")).distinct(), "line-ids")
    sets = materialise(lines.select("seq", "r").join(F.broadcast(ids) if _few(ids) else ids, "seq", "left_semi"), "line-sets", dictionary=False)
    both = pairs.join(sets.select(F.col("seq").alias("x"), F.col("r").alias("a")), "x").join(sets.select(F.col("seq").alias("y"), F.col("r").alias("b")), "y")
    near = both.where(F.size(F.array_intersect("a", "b")) * 9 >= (F.size("a") + F.size("b")) * 4).select("y").distinct()
    return near, [ids, sets]


def _in_turns(one: Callable[[DataFrame, int], DataFrame], count: int, heads: DataFrame, lines: DataFrame) -> DataFrame:
    """Verified `y` of the pairs of all turns, of which the rows of one alone are on disk at a time."""
    turns = [materialise(one(heads, t), "line-pairs") for t in range(count)]
    near, used = _verified(reduce(DataFrame.unionByName, turns).distinct(), lines)
    near = materialise(near, "line-near")
    drop_tables(*turns, *used)
    return near


def similar_lines(lines: DataFrame) -> DataFrame:
    """`y`: the `seq` of the lines that an earlier line of `lines(seq, r)` is similar to or equals as a set."""
    heads = materialise(_heads(lines, rarity(lines)), "line-heads", dictionary=False)
    near = _in_turns(_to_pivots, PIVOT_TURNS, heads, lines)
    known = near.select(F.col("y").alias("seq"), F.lit(False).alias("alone"))
    few = _few(known)
    marked = heads.where("n >= 4").join(F.broadcast(known) if few else known, "seq", "left").withColumn("alone", F.coalesce("alone", F.lit(True)))
    if not few:  # joined once, not in every turn
        marked = materialise(marked, "line-marked", dictionary=False)
    out = materialise(near.unionByName(_in_turns(_pairs, PAIR_TURNS, marked, lines)), "line-similar")
    drop_tables(heads, near, *[marked] * (not few))
    return out


def _kept(docs: DataFrame) -> tuple[_Places, DataFrame]:
    """(places, (key, kept)): the places of the lines that stay, blank ones left out, of `docs(doc_id, text)`.

    They are the first places of their lines, so what stays is known without the texts; all other lines are copies.
    """
    places = _Places(docs)
    first = materialise(line_table(docs, places), "line-table", dictionary=False)
    near = similar_lines(first)
    stay = first.select("seq").join(near.select(F.col("y").alias("seq")), "seq", "left_anti")
    place = F.col("seq").bitwiseAND(F.lit((1 << places.bits) - 1)).cast("int")
    kept = materialise(stay.groupBy(F.shiftright("seq", places.bits).alias("key")).agg(F.collect_set(place).alias("kept")), "line-kept")
    drop_tables(first, near)
    return places, kept


def _rewritten(docs: DataFrame, places: _Places, kept: DataFrame, *columns: str) -> DataFrame:
    """`columns` of `docs(doc_id, text, ..)`, with `text` rewritten, its lines counted before (`n_lines`) and after (`n_kept`)."""
    none = F.array().cast("array<int>")
    # by a shuffle at any size, so that small inputs run the plan of large ones, where a row for each document can't be broadcast
    split = places.keyed(docs).join(kept.hint("merge"), "key", "left").select(*columns, "text", F.split("text", "\n").alias("lines"), F.when(F.col("key").isNotNull(), F.coalesce("kept", none)).alias("kept"))
    # rows that repeat an id may have fewer lines
    within = F.filter("kept", lambda i: i < F.size("lines"))
    blank = F.array_remove(F.transform("lines", lambda x, i: F.when(_blank(x), i).otherwise(-1)), F.lit(-1))
    stay = split.select(*columns, "text", "lines", F.array_union(within, blank).alias("stay"))
    whole = F.col("stay").isNull() | (F.size("stay") == F.size("lines"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines"))
    # the places are looked up in order, so a text of many lines costs no more than sorting them
    text = F.when(whole, F.col("text")).otherwise(F.array_join(F.transform(F.sort_array("stay"), lambda i: F.get("lines", i)), "\n"))
    return stay.select(*columns, text.alias("text"), n_lines.cast("long").alias("n_lines"), F.when(whole, n_lines).otherwise(F.size("stay")).cast("long").alias("n_kept"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_lines, n_removed), one row per row of `docs`, texts without the lines that go."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = _rewritten(docs, *_kept(docs), "doc_id")
    return out.select("doc_id", "text", "n_lines", (F.col("n_lines") - F.col("n_kept")).alias("n_removed"))


def rewrite(docs: DataFrame) -> DataFrame:
    """`docs`, all columns, with `text` rewritten and `n_chars` counted anew."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = _rewritten(whole, *_kept(narrow), "row")
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_kept") == F.col("n_lines"), F.col("row.n_chars")).otherwise(F.length("text").cast("long"))}
    return out.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
