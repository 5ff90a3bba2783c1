"""Language ID, licences, SimHash, line dedup, quality: against brute force, and on odd input."""

import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quiverline.llm import langid, licenses, linededup, quality, simhash
from quiverline.llm.common import connected_components

ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "the licence of this"), (4, "same same"), (4, "same same"), (5, "\x00� 😀 ¿"), (6, "word " * 60_000)]


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


@pytest.mark.parametrize("rows", [[], ODD])
def test_odd_input(spark, frame, rows):
    docs = frame(rows)
    ids = sorted([-1 if i is None else i for i, _ in rows])
    labels = spark.createDataFrame([(4, 1)], "doc_id long, quality int")
    proto = langid.fit(docs)
    for df in (langid.predict(docs, proto), licenses.scan_licenses(docs), simhash.near_duplicates(docs), linededup.dedup_lines(docs), quality.classify(docs, labels), quality.classify(docs, labels.limit(0))):
        assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in df.collect()) == ids


# -- language -----------------------------------------------------------------------------------------------------------


def sentence(rng, words, n=40):
    return " ".join(rng.choice(words) for _ in range(n))


WORDS = {"en": "the and with from that this have which there would".split(), "de": "der die das und nicht eine über schön größe ich".split(), "es": "que el los para con una niño está también más".split()}


def test_languages_are_learned_and_told_apart(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng, WORDS[lang]), lang) for i, lang in enumerate(list(WORDS) * 40)] + [(900, "12 34 !!", "en"), (901, None, "en"), (902, "the and", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = langid.held_out(F.col("doc_id"))
    got = by_id(langid.predict(docs, langid.fit(docs.where(~held))))
    test = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert {r[0] for r in test} == {r["doc_id"] for r in docs.where(held).collect()}
    assert np.mean([got[r[0]][0]["lang_pred"] == r[2] for r in test if r[0] < 900]) == 1.0
    for i in (900, 901):
        assert (got[i][0]["lang_pred"], got[i][0]["score"]) == ("und", 0.0)
    assert all(0 <= r["score"] <= 1 for x in got.values() for r in x)
    kept = {r["doc_id"] for r in langid.keep(docs, langid.fit(docs)).collect()}
    assert kept == {r[0] for r in rows} - {900, 901}


def test_nothing_learned_is_und(spark, frame):
    got = langid.predict(frame([(1, "hello there")]), {}).first()
    assert (got["lang_pred"], got["score"]) == ("und", 0.0)


UNLEARNED = {
    "pl": "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa ",
    "fi": "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto ja heidän on toimittava toisiaan kohtaan veljeyden hengessä ",
    "ru": "все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства ",
    "el": "ολοι οι ανθρωποι γεννιουνται ελευθεροι και ισοι στην αξιοπρεπεια και τα δικαιωματα ειναι προικισμενοι με λογικη και συνειδηση και οφειλουν να συμπεριφερονται μεταξυ τους ",
    "zh": "人人生而自由在尊严和权利上一律平等他们赋有理性和良心并应以兄弟关系的精神相对待人人有资格享有本宣言所载的一切权利和自由不分种族肤色性别语言宗教政治或其他见解",
}


def test_gibberish_goes_and_languages_not_learned_stay(spark):
    rng = random.Random(8)
    learned = [(i, sentence(rng, WORDS[lang]), lang) for i, lang in enumerate(list(WORDS) * 40)]
    proto = langid.fit(spark.createDataFrame(learned, "doc_id long, text string, lang string"))
    letters = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 10))) for _ in range(n)) for n in (80, 300, 1500) for _ in range(10)]
    base64 = ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n)) for n in (500, 2000, 9000) for _ in range(10)]
    rows = [(i, t) for i, t in enumerate(UNLEARNED[k] * 3 for k in UNLEARNED)] + [(100 + i, t) for i, t in enumerate(letters + base64)]
    kept = {r["doc_id"] for r in langid.keep(spark.createDataFrame(rows, "doc_id long, text string"), proto).collect()}
    assert kept == set(range(len(UNLEARNED)))


def test_a_bundle_is_the_sum_of_bound_trigrams():
    enc = langid.Encoder()
    v, n = enc.bundle(["abc", None])
    a, b, c = 1, 2, 3
    want = sum(enc.place[0][x] * enc.place[1][y] * enc.place[2][z] for x, y, z in ((0, a, b), (a, b, c), (b, c, 0)))
    assert n.tolist() == [3, 0] and np.array_equal(v[0], want) and not v[1].any()
    whole, _ = enc.bundle(["xy zé" * 50])
    assert np.array_equal(whole[0], enc.bundle(["xy zé" * 50, "q"])[0][0])


# -- licences -----------------------------------------------------------------------------------------------------------


def base_by_hand(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    found = [(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def test_base_phrases_as_by_hand():
    rng = random.Random(2)
    parts = ["under the MIT License", "Apache License,  Version 2.0", "CC-BY-NC 4.0", "under the", "mit", "license", "é", "cc by", "nc", "xcc by nc", "\n", "--", "apache license version 20"]
    for _ in range(500):
        text = rng.choice([" ", "\t", "/"]).join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert licenses.scan_text(text)[:5] == base_by_hand(text)
    assert licenses.scan_text("under the mit license")[6] == 1.0


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("SPDX-License-Identifier: MPL-2.0", "mpl-2"), ("Released under the GNU General Public License v3", "gpl-3"), ("licensed under the GNU Lesser General Public License version 2.1", "lgpl-2.1"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"), ("This is free and unencumbered software released into the public domain.", "unlicense"), ("licensed under CC BY-SA 4.0", "cc-by-sa"), ("All rights reserved.", "all-rights-reserved"),
    ],
)
def test_rules_detect(text, label):
    got = licenses.scan_text(f"Some words. {text} More words.")
    assert label in got[5].split(",") and got[1] == 0 and 0 < got[6] <= 1


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("licensed under the BSD license", "bsd"), ("the GNU General Public License", "gpl"), ("Apache License", "apache"), ("GNU Lesser General Public License", "lgpl"), ("released under the AGPL", "agpl"),
        ("Mozilla Public License", "mpl"), ("licensed under the Apache License, Version 2.0", "apache-2"), ("licensed under the GNU General Public License v3", "gpl-3"), ("the BSD 3-Clause License", "bsd-3"),
        ("GNU General Public License version 2", "gpl-2"), ("Affero General Public License version 3", "agpl-3"), ("the Apache License 2.0", "apache-2"),
    ],
)
def test_names_without_a_version(text, label):
    assert licenses.scan_text(f"Some words. {text}. More words.")[5] == label


def places_by_hand(norm):
    """Accepted detections, by the definition: every rule on every text, one interval held against all accepted ones."""
    kept = []
    for label, _, _, expression in licenses.license_rules.parsed():
        for m in re.finditer(rb"(?:(?<= )|^)(?:" + expression.encode() + rb")(?= |$)", norm):
            if not any(a <= m.start() and m.end() <= b for a, b, _ in kept):
                kept.append((m.start(), m.end(), label))
    return sorted(kept)


def test_rules_as_by_hand():
    rng = random.Random(19)
    parts = ["licensed under the", "GNU", "lesser", "General Public License", "version 2", "or later", "Apache License, Version 2.0", "MIT license", "all rights reserved", "the public domain", "CC BY-NC", "SA 4.0", "BSD 3-Clause", "word", "2.1"]
    for _ in range(200):
        norm = licenses.normal(" ".join(rng.choice(parts) for _ in range(rng.randint(0, 25))))
        assert sorted((a, b, label) for a, b, label, _ in licenses.rule_places(norm)) == places_by_hand(norm)


def test_rules_are_different():
    texts = [expression for *_, expression in licenses.license_rules.parsed()]
    assert len(set(texts)) == len(texts) > 300


def test_a_long_text_with_many_detections():
    n = 40_000
    got = licenses.scan_text("Under the MIT license; all rights reserved\n" * n)
    assert got[:4] == (7 * n, n, 0, 7 * n - 7) and len(got[7]) == 2 * n and got[5] == "all-rights-reserved,mit"


def test_rules_are_gated_and_contained_detections_go():
    assert licenses.scan_text("the apache tribe of zero clauses and the mozilla")[5] == ""
    spans = [(a, b) for a, b, *_ in licenses.scan_text("licensed under the apache license version 2 0 and released under the mit license")[7]]
    assert not any(a <= c and d <= b and (a, b) != (c, d) for a, b in spans for c, d in spans)


# -- near copies --------------------------------------------------------------------------------------------------------


def test_the_unfolded_index_is_never_broadcast(spark):
    nodes = spark.range(50).selectExpr("xxhash64(id) AS fp")
    plan = simhash.links(nodes)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_as_by_hand():
    for text in (None, "", "  ", "one", "a b c", "A b\tC\nd", "É é x y z w", "q " * 50, "the cat sat on the mat and looked at the dog"):
        assert simhash.fingerprint(text) % (1 << 64) == plain_fingerprint(text)
    assert simhash.fingerprint("w%d " * 1) and simhash.fingerprint(" ".join(f"w{i}" for i in range(40_000))) % (1 << 64) == plain_fingerprint(" ".join(f"w{i}" for i in range(40_000)))


def test_all_links_are_found(spark):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for f in list(fps)[:150]:
        g = f
        for b in rng.sample(range(64), rng.randint(1, 6)):
            g ^= 1 << b
        fps.add(g)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = [signed(f) for f in fps]
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(f,) for f in nodes], "fp long")).distinct().collect()}
    want = {(min(a, b), max(a, b)) for i, a in enumerate(nodes) for b in nodes[:i] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4}
    assert want and got == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 90), (90, 95), (200, 200), (None, 1)] + [(1000, i) for i in range(1001, 1040)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 90: 90, 95: 90, 100: 90, **dict.fromkeys(range(1000, 1040), 1000)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_copies_share_a_component(spark, frame):
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(400)]
    near = base.copy()
    near[7] = "changed"
    rows = [(10, " ".join(base)), (4, " ".join(base).upper()), (7, " ".join(near)), (8, " ".join(f"v{rng.randint(0, 5000)}" for _ in range(300))), (2, None), (3, "  "), (None, " ".join(base))]
    got = {k: v[0]["component_id"] for k, v in by_id(simhash.near_duplicates(frame(rows))).items()}
    assert got[10] == got[4] == 4 and got[8] == 8 and got[2] == got[3] == 2 and got[None] is None
    near_bits = ((simhash.fingerprint(rows[0][1]) ^ simhash.fingerprint(rows[2][1])) & ((1 << 64) - 1)).bit_count()
    assert (got[7] == 4) == (near_bits <= 4)
    one = simhash.representatives(frame(rows), ["doc_id", "text", "lang", "source", "n_chars"])
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in one.collect()) == sorted([-1, 2, 4, 8] + ([7] if near_bits > 4 else []))


# -- lines --------------------------------------------------------------------------------------------------------------


def lines_by_hand(rows):
    seen, out = [], {}
    order = [(i, t) for i, t in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0])]
    for doc, text in order:
        kept = []
        for line in text.split("\n"):
            words = frozenset(w for w in re.split(r"[ \t\n\x0b\f\r]+", line.lower()) if w)
            if words and any(len(words & s) * 5 >= len(words | s) * 4 for s in seen):
                seen.append(words)
                continue
            if words:
                seen.append(words)
            kept.append(line)
        out[doc] = "\n".join(kept)
    return out


def test_lines_as_by_hand(spark, frame):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    lines = [" ".join(rng.sample(vocabulary, rng.randint(1, 25))) for _ in range(60)]

    def variant(line):
        words = line.split()
        words[rng.randrange(len(words))] = rng.choice(vocabulary)
        return " ".join(words)

    rows = []
    for doc in range(60):
        text = [variant(x) if rng.random() < 0.6 else x for x in rng.sample(lines, rng.randint(0, 6))]
        rows.append((doc * 3, "\n".join(text) + rng.choice(["", "\n", "\n\n  \n"])))
    rows += [(500, None), (None, lines[0]), (501, lines[0].upper() + "\r")]
    got = {k: v[0] for k, v in by_id(linededup.dedup_lines(frame(rows))).items()}
    want = lines_by_hand(rows)
    assert {k: got[k]["text"] for k in want} == want
    assert got[500]["text"] is None and got[None]["text"] == lines[0]
    assert sum(r["n_removed"] for r in got.values()) > 20
    # the same without the first round by earliest lines, and for ids that don't fit beside the lines' places
    far = [(None if i is None else i * 10**15 - 10**17, t) for i, t in rows]
    moved = {k: v[0]["text"] for k, v in by_id(linededup.dedup_lines(frame(far))).items()}
    assert {k: moved[k * 10**15 - 10**17] for k in want} == want


def test_rewritten_documents_keep_their_columns(frame):
    docs = frame([(1, "a b c d\nx y"), (2, "x y\nnew")])
    got = {r["doc_id"]: r for r in linededup.rewrite(docs).collect()}
    assert got[2]["text"] == "new" and got[2]["n_chars"] == 3 and got[1]["n_chars"] == 11 and set(docs.columns) == set(got[1].asDict())
    clashing = docs.selectExpr("doc_id", "text", "n_chars", "5 AS key", "'g' AS gone", "1 AS row", "true AS same", "7 AS seq")
    more = linededup.rewrite(clashing)
    assert more.columns == clashing.columns
    assert sorted(map(tuple, more.collect())) == [(1, "a b c d\nx y", 11, 5, "g", 1, True, 7), (2, "new", 3, 5, "g", 1, True, 7)]


def test_lines_of_many_words_and_parity_words(spark):
    """Lines over and under the length from which there are four parity words, against all pairs."""
    rng = random.Random(23)
    lines = []
    for base in range(12):
        words = [f"b{base}x{i}" for i in range(rng.choice([140, 150, 158, 165, 200, 330]))]
        for _ in range(4):
            out = [w if rng.random() > 0.045 else f"e{rng.randrange(10**6)}" for w in words]
            lines.append(" ".join(out[: len(out) - rng.randrange(12)]))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    sets = [set(x.split()) for x in lines]
    want = {i for i in range(len(sets)) if any(9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])) for j in range(i))}
    assert {r["doc_id"] for r in linededup.dedup_lines(docs).where("n_removed > 0").collect()} == want and 5 < len(want) < 36


def test_line_table_and_prefixes_are_cheap(spark, frame):
    """No sorted aggregation of texts, no sorting of boxed numbers, and texts read twice only: for their lines and to be rewritten."""
    docs = frame([(1, "a b c d\nx y"), (2, "x y\nnew")])
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    lines = linededup.line_table(docs, linededup._Places(docs))
    assert "SortAggregate" not in plan(lines) and "HashAggregate" in plan(lines)
    heads = linededup._heads(lines, [0] * linededup.BUCKETS)
    head = heads.schema["head"].dataType
    assert not head.containsNull
    out = plan(linededup.dedup_lines(docs))
    assert "xxhash64" not in out and "array_contains" not in out and out.count("split(") == 1


def test_earliest_lines_are_met_without_a_join(spark, frame):
    docs = frame([(3, "a b c d e"), (1, "e d c b a"), (2, "b a c d e\nf g h i"), (4, "x y"), (5, "y x")])
    heads = linededup._heads(linededup.line_table(docs, linededup._Places(docs)), [0] * linededup.BUCKETS)
    met = linededup._to_pivots(heads, 0)
    text = met._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and text.count("Generate explode") == 1
    bits = linededup._Places(docs).bits
    assert linededup.PIVOT_TURNS > 1 or sorted((r["x"] >> bits, r["y"] >> bits) for r in met.collect()) == [(1, 2), (1, 3), (4, 5)]


def test_documents_of_many_lines_and_repeated_ids(spark):
    rng = random.Random(8)
    lines = [f"w{rng.randrange(40)} x{rng.randrange(40)} y{rng.randrange(30)} z{rng.randrange(4)}" if rng.random() < 0.9 else " \t" for _ in range(30_000)]
    seen, kept = set(), []
    for x in lines:
        words = frozenset(x.split())
        if not words or words not in seen:
            kept.append(x)
        seen.add(words)
    rows = [(1, "\n".join(lines)), (2, "one two three four\n\nfive six"), (2, "five six seven eight nine\nalone here"), (3, "FOUR three two one"), (4, " \n\n")]
    got = {(r["doc_id"], r["n_lines"]): r for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1, 30_000]["text"] == "\n".join(kept) and got[1, 30_000]["n_removed"] == 30_000 - len(kept) > 100
    assert got[2, 3]["text"] == rows[1][1] and got[2, 2]["text"] == rows[2][1] and got[4, 3]["text"] == " \n\n"
    assert got[3, 1]["text"] == "" and got[3, 1]["n_removed"] == 1


# -- quality ------------------------------------------------------------------------------------------------------------


def grams_by_hand(text):
    words = re.findall(r"[^\W_]+|[!-/:-@\[-`{-~]+", text or "")
    return 2 * len(words) - 1 if words else 0


def test_ngrams_are_counted_and_the_same_wherever_a_text_stands():
    texts = ["Hello, world! x", None, "", "  ", "a", "a", "$$ %% a1"]
    ids, n = quality.ngrams(texts)
    assert n.tolist() == [grams_by_hand(t) for t in texts] and len(ids) == n.sum()
    ends = np.cumsum(n)
    for t, end, size in zip(texts, ends, n):
        alone, _ = quality.ngrams([t])
        assert sorted(alone.tolist()) == sorted(ids[end - size : end].tolist())


def test_kth_largest_is_exact(spark):
    rng = np.random.default_rng(6)
    for values in (rng.normal(size=3000).tolist(), [1.0] * 50 + [2.0] * 5 + [float("-inf")], [5.0], [1e300, -1e300, 0.0]):
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        finite = sorted((v for v in values if np.isfinite(v)), reverse=True)
        for k in {1, 2, len(finite) // 2, len(finite)}:
            if 1 <= k <= len(finite):
                assert quality.kth_largest(df, "v", k, bins=16) == finite[k - 1]
        assert quality.kth_largest(df, "v", 0) == float("inf") and quality.kth_largest(df, "v", 10**6) == float("-inf")


def test_junk_goes_and_clean_text_stays(spark):
    rng = random.Random(7)
    words = [f"{a}{b}" for a in ("re", "con", "de", "pro", "in") for b in ("form", "tain", "vide", "sist", "duct", "fer")]
    clean = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(5, 80))) + ".") for i in range(400)]
    junk = [(1000 + i, " ".join(rng.choice(words).upper() + "$$$ |" for _ in range(rng.randint(20, 80)))) for i in range(100)]
    docs = spark.createDataFrame(clean + junk + [(2000, None), (2001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)] + [(1000 + i, 0, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    got = {k: v[0]["kept"] for k, v in by_id(quality.classify(docs, labels)).items()}
    assert np.mean([got[i] for i, _ in clean]) >= 0.99 and not any(got[i] for i, _ in junk) and not got[2000] and not got[2001]
    model, _ = quality.train(docs, labels)
    assert {r["doc_id"] for r in quality.keep(docs, model).collect()} == {k for k, v in got.items() if v}
