"""WARC, SentencePiece and packing: exact round trips, and the libraries' own results."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverline.llm import packing, pieces, warc

public_tokenizers = pytest.importorskip("public_tokenizers")


# -- archives -----------------------------------------------------------------------------------------------------------


def test_url_keys():
    assert warc.url_key("https://www.Example.com:80/a b?c") == "com,example,www)/a%20b?c"
    assert warc.url_key("http://x.org:8080") == "org,x:8080)/"
    assert warc.url_key(None) == warc.url_key("") == "-"
    assert warc.url_key("http://[broken/\n") == "http://[broken/%0A"


def test_records_round_trip():
    for payload in (b"", "é\r\n\r\nWARC/1.1\r\n".encode(), b"x" * 5000):
        r = warc.parse_record(warc.build_record(7, "http://a/\r\nX: y", payload, None, None))
        assert (r.kind, r.page_id, r.payload, r.payload_bytes, r.refers_to) == ("response", 7, payload, len(payload), None)
        r = warc.parse_record(warc.build_record(None, None, payload, 9, "http://b/"))
        assert (r.kind, r.page_id, r.payload, r.payload_bytes, r.refers_to) == ("revisit", None, None, len(payload), 9)
    with pytest.raises(ValueError, match="digest"):
        warc.parse_record(warc.build_record(7, None, b"abc", None, None).replace(b"abc\r\n", b"abd\r\n"))


def test_archives_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    big = "é" * 600
    rows = [(i, f"http://h{i % 4}.org/p{i % 3}", "page %d " % i * (i * 3)) for i in range(60)]
    rows += [(100, "http://x.org/", big), (101, None, big), (99, "http://x.org/", big), (102, "u", "small"), (103, "u", "small"), (104, "u", None), (None, "http://x.org/", big), (101, None, big)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record_type string")
    got = sorted((tuple(r) for r in warc.round_trip(pages).collect()), key=str)
    import hashlib

    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        to = 101 if html == big and i in (99, 100) else None
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if to else "response", to))
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_lookup_finds_one_page(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    pages = spark.createDataFrame([(i, f"http://h.org/{i}", f"text {i}") for i in range(50)], "page_id long, url string, html string")
    captures = warc.write_archives(warc.mark_revisits(pages), folder).cache()
    shards = warc.build_index(captures, f"{folder}/index", block_lines=4)
    wanted = spark.createDataFrame([("org,h)/17", 17), ("org,h)/17", 18), ("zzz", 1)], "key string, page_id long")
    found = warc.read_captures(warc.lookup(wanted, f"{folder}/index", shards), folder, keep_payload=True).collect()
    assert [(r["page_id"], bytes(r["payload"])) for r in found] == [(17, b"text 17")]


# -- pieces -------------------------------------------------------------------------------------------------------------

TEXTS = ["", " ", "a  b", " lead", "trail ", "x\n\ny", "日本語 テキスト", "😀 é", "▁ mark", "a\x00b", "internationalization of understanding", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "http://www.example.com/?a=1&b=2", "    four"]


def random_texts(n, seed):
    rng = random.Random(seed)
    bits = ["the", "ing", "tion", "er", "in", "an", "on", " ", " ", "s", "es", "re", "é", ".", ",", "\n", "▁", "ß", "1", "20"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_ids_are_the_librarys():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    enc, texts = pieces.Encoder(pieces.default_model()), TEXTS + random_texts(1500, 8)
    for t, ids in zip(texts, enc.encode(texts)):
        assert ids.tolist() == sp.encode(t), t
        assert enc.decode(ids) == t.replace("▁", " ") == sp.decode(ids.tolist()), t
    assert enc.encode([]) == [] and enc.encode([None])[0].tolist() == []


def test_every_occurrence_is_an_edge():
    enc = pieces.Encoder(pieces.default_model())
    text = "▁the▁theory\0▁there"
    start, row = enc.edges(enc.known[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)])
    got = {(int(s), enc.v.names[enc.piece_ids[r]]) for s, r in zip(start, row)}
    want = {(i, text[i:j]) for i in range(len(text)) for j in range(i + 1, min(len(text), i + enc.v.longest) + 1) if text[i:j] in enc.v.id_of}
    assert got == want


def test_frames_encode_and_decode(spark, frame):
    rows = list(enumerate(TEXTS)) + [(None, "x y"), (70, None), (71, "long " * 50_000)]
    out = pieces.encode(frame(rows)).cache()
    assert out.count() == len(rows) and out.where("not round_trip").count() == 0
    back = {r["doc_id"]: r["text"] for r in pieces.decode(out).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in rows)
    assert pieces.encode(frame([])).count() == 0


# -- packing ------------------------------------------------------------------------------------------------------------


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_batch_tokens_are_the_librarys():
    texts = [*TEXTS, "it's we'll 's  'S", "a ", "a \n b", "x\x1c y \x1cz", "12 34", "<|endoftext|> x", "a <|endoftext|> b", " <|endoftext|><|endoftext|>  \n", "<|endoftext", *random_texts(800, 9)]
    tok = packing.BatchTokenizer(packing.default_vocabulary())
    for _ in range(2):
        assert [x.tolist() for x in tok.encode(texts)] == library_ids(texts)


def check_packing(rows, texts):
    ids = {i: [*x, 0] for (i, _), x in zip(texts, library_ids([t or "" for _, t in texts]))}
    at, seqs = {}, {}
    for r in sorted(rows, key=lambda r: (str(r["doc_id"]), r["start"])):
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == at.get(r["doc_id"], 0) and len(part) == r["length"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(np.array(part, dtype="<u4").tobytes())
        at[r["doc_id"]] = r["start"] + r["length"]
        seqs.setdefault(r["sequence_id"], []).append(r)
    assert at == {i: len(x) for i, x in ids.items()}
    padding = 0
    for s in seqs.values():
        end = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]
        assert end <= 1024 and s[0]["context_size"] == (end if end & (end - 1) == 0 else 1024)
        padding += s[0]["context_size"] - end
    return padding


def test_packing_covers_each_id_once(frame):
    rng = random.Random(10)
    texts = [(i, t) for i, t in enumerate(random_texts(300, 11))] + [(1000 + i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(0, 3000)))) for i in range(40)] + [(2000, None), (2001, ""), (None, "null id")]
    rows = packing.pack(frame(texts).repartition(3)).collect()
    assert check_packing(rows, texts) == 0
    assert packing.pack(frame([])).count() == 0
    twice = packing.pack(frame([(5, "a b"), (5, "a b"), (6, "x <|endoftext|> y")])).collect()
    assert sum(r["length"] for r in twice if r["doc_id"] == 5) == 2 * 3 and sum(r["length"] for r in twice if r["doc_id"] == 6) == len(library_ids(["x <|endoftext|> y"])[0]) + 1


def test_step_groups_are_even():
    p = packing.Packer(step_tokens=8192)
    rng = random.Random(12)
    for i in range(2000):
        p.add(i, np.zeros(rng.choice([40, 300, 700, 5000]), dtype=np.uint32))
    p.pack(True)
    size = {}
    for r in {r[5]: r for r in p.rows}.values():
        size[r[8]] = size.get(r[8], 0) + r[7]
    full = sorted(size.values())
    assert full[1] >= 8192 - 1024 and full[-1] <= 8192 + 1024
