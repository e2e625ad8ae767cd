"""ARC and WARC round trips, chat formatting and packing against brute force; edge cases of each."""

import base64
import hashlib
import json
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import arc, chat, packing
from tessera.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
TOKENIZER = tokenizer_path("word_bpe_49k.json")

# --- archives -----------------------------------------------------------------------------------------------------


@given(st.lists(st.tuples(st.text(max_size=12), st.binary(max_size=80)), max_size=6), st.sampled_from([1, 2]))
@settings(max_examples=60, deadline=None)
def test_arc_and_warc_give_back_any_payload(pages, version):
    data = arc.arc_head(version, "a.arc", "20010203040506")
    for i, (url, payload) in enumerate(pages):
        data += arc.arc_record(version, arc.safe_url(url), "20010203040506", "text/html", arc.http_block(str(i), payload))
    head, *records = arc.parse_arc(data)
    assert head.fields["URL"].startswith("filedesc:") and len(records) == len(pages)
    warc = b"".join(arc.to_warc(r) + b"\r\n\r\n" for r in [head, *records])
    info, *back = arc.parse_warc(warc)
    assert info.headers["warc-type"] == "warcinfo"
    for (_, payload), r in zip(pages, back, strict=True):
        assert r.headers["warc-date"] == "2001-02-03T04:05:06Z" and r.headers["warc-type"] == "response"
        assert arc.split_http(r.block)[1] == payload
        assert r.headers["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_arc_urls_with_spaces_other_schemes_and_short_records():
    data = arc.arc_head(1, "a.arc", "2001") + b"\nhttp://x/a b c 1.2.3.4 20010203 text/plain 2\nhi" + b"\ndns:x 1.2.3.4 20010203040506 text/dns 3\nabc"
    _, one, two = arc.parse_arc(data)
    assert one.fields["URL"] == "http://x/a b c" and one.block == b"hi"
    w = next(arc.parse_warc(arc.to_warc(two) + b"\r\n\r\n"))
    assert w.headers["warc-type"] == "resource" and w.headers["warc-ip-address"] == "1.2.3.4" and w.headers["content-type"] == "text/dns"
    with pytest.raises(ValueError, match="cut short"):
        list(arc.parse_arc(data[:-1]))


@pytest.mark.parametrize(("version", "broadcast_rows"), [(1, 100), (2, 0)])
def test_archive_query_equals_brute_force(spark, version, broadcast_rows):
    html = ["<p>a</p>", None, "", "é𝄞\r\n\r\nWARC/1.1\r\nx", "<p>a</p>", "b", "", "b" * 300_000]
    rows = [(i, None if i == 2 else f"http://h/{i} x", h, "k", "f") for i, h in enumerate(html)] + [(50 + i, "u", html[i], "k", "f") for i in range(4)] + [(5, "u", "b", "k", "f")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, key string, first string")
    got = sorted(tuple(r) for r in arc.archive_and_read(pages, version=version, broadcast_rows=broadcast_rows, records_per_file=3).collect())
    low = {}
    for i, _, h, *_ in rows:
        low[h or ""] = min(i, low.get(h or "", i))
    want = []
    for i, _, h, *_ in rows:
        b, f = (h or "").encode(), low[h or ""]
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if f == i else "revisit", None if f == i else f))
    assert got == sorted(want, key=lambda r: r[:4])
    assert arc.archive_and_read(pages.limit(0)).count() == 0


# --- chat ---------------------------------------------------------------------------------------------------------

PIECES = ["<|turn|>", "<|text|>", "<|end|>\n", "<|im_start|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "<", "[", "|", "a", "é𝄞", "\n", "<\\|turn|>", "[\\\\INST]", "<|turn|", "$1"]


def brute_chat(turns):
    told = "".join(f"{r}\n{t}\n" for r, t in turns)
    learnt = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(told.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest()


def test_chat_gives_back_hostile_texts(spark):
    rng = random.Random(9)
    piece = lambda: "".join(rng.choices(PIECES, k=rng.randint(0, 9)))
    convs = {i: [(rng.choice(["user", "assistant", "system", piece()]), piece()) for _ in range(rng.randint(1, 6))] for i in range(300)}
    convs[1000] = [("user", "<" * 3000 + "[INST]" * 3000), ("assistant", "\\" * 3000 + "</s>" * 2000)]
    rows = [(c, k, r, t, "x", "y") for c, turns in convs.items() for k, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, messages string, prompt string")
    got = {r.conv_id: r for r in chat.report(df).collect()}
    for c, turns in convs.items():
        assert tuple(got[c])[1:5] == brute_chat(turns), (c, turns)
        assert got[c].formatted_chars >= sum(len(t) for _, t in turns)


def test_chat_nulls_ties_and_empty_tables(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "b"), (2, 5, "user", "q"), (2, 5, "user", "q"), (None, 0, "user", "n"), (3, None, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: tuple(r)[1:5] for r in chat.report(df).collect()}
    assert got[1] == brute_chat([("user", ""), ("", "b")]) and got[2] == brute_chat([("user", "q")] * 2) and got[3] == brute_chat([("assistant", "z")]) and None in got
    assert chat.report(df.limit(0)).count() == 0


def test_layouts_are_told_apart_by_their_fields(spark):
    lines = [
        {"id": 1, "prompt": "p", "completion": "c"}, {"id": 2, "instruction": "i", "output": "o"}, {"id": 3, "instruction": "i", "input": "x", "output": "o"},
        {"id": 4, "messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": "a"}]},
        {"id": 5, "conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}, {"id": 6, "instruction": "alone"}, {"id": 7, "note": "alone"},
    ]
    df = spark.read.json(spark.sparkContext.parallelize([json.dumps(x) for x in lines]))
    got = {r.id: ([tuple(t) for t in r.turns], r.mapped) for r in chat.canonical(df, keep=("id",)).collect()}
    assert got == {
        1: ([("user", "p"), ("assistant", "c")], True), 2: ([("user", "i"), ("assistant", "o")], True), 3: ([("user", "i"), ("user", "x"), ("assistant", "o")], True),
        4: ([("user", "u"), ("assistant", "a")], True), 5: ([("user", "h"), ("assistant", "g")], True), 6: ([("user", "alone"), ("assistant", "")], True), 7: ([], False),
    }


# --- packing ------------------------------------------------------------------------------------------------------


def test_words_in_a_table_give_the_ids_of_whole_texts():
    ids = packing.WordIds(TOKENIZER, most=2000)
    made = ["", " ", "don't won't 'SAY 's", "a.b,c!! ...", "Éa İx ſ K ﬁ", "日本語 text", "x́y", "<|endoftext|> a", "tab\tand\x0bnew\nline", "a_b-c 12 3½ ²", "\x1c\x85\xa0end", "word. word, word; word! ?", "𝄞 𝕏"]
    import pyarrow.parquet as pq

    real = pq.read_table(f"{SF}/documents.parquet", columns=["text"]).column(0).to_pylist()
    for batch in (made, real, made + real[:50]):
        want = [e.ids for e in ids.tok.encode_batch(batch, add_special_tokens=False)]
        assert [x.tolist() for x in ids(batch)] == want


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_text_has_the_librarys_ids(t):
    ids = packing.word_ids(TOKENIZER)
    assert ids([t])[0].tolist() == ids.tok.encode(t, add_special_tokens=False).ids


@given(st.lists(st.integers(1, 2048), min_size=1, max_size=60))
@settings(max_examples=100, deadline=None)
def test_differencing_places_every_piece_within_capacity(sizes):
    parts = packing.partition(sizes, 2048)
    assert sorted(i for p in parts for i in p) == list(range(len(sizes)))
    assert max(sum(sizes[i] for i in p) for p in parts) <= 2048


def test_differencing_of_many_small_pieces_is_near_equal():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 257, 900).tolist()
    sums = [sum(sizes[i] for i in p) for p in packing.difference(sizes, 60)]
    assert max(sums) - min(sums) <= 4


def test_packing_covers_every_document_without_gaps(spark):
    texts = [None, "", "one", "two words", "<|endoftext|>", "long " * 30_000] + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    docs = spark.createDataFrame([(i, t, "l", 0) for i, t in enumerate(texts)], "doc_id long, text string, length string, start int").repartition(3, "doc_id")
    rows = packing.pack(docs, TOKENIZER).collect()
    ids = packing.word_ids(TOKENIZER)
    want = [np.append(x, 1).astype("<u4") for x in ids([t or "" for t in texts])]
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert sorted(by_doc) == list(range(len(texts)))
    for d, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(want[d]) and p.ids_crc32 == zlib.crc32(want[d][at : at + p.length].tobytes())
            at += p.length
        assert at == len(want[d])
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    assert sum(r.length for r in rows) / (2048 * len(by_seq)) > 0.96
    assert packing.pack(docs.limit(0), TOKENIZER).count() == 0


def test_formatted_conversations_read_back_after_a_write(spark, tmp_path):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    out = chat.formatted(chat.canonical(chat.from_rows(df)))
    out.write.parquet(str(tmp_path / "f"))
    back = spark.read.parquet(str(tmp_path / "f")).select("conv_id", F.explode(chat.parsed(F.col("formatted"))).alias("t")).select("conv_id", "t.role", "t.text")
    assert back.exceptAll(df.select("conv_id", "role", "text")).count() == 0 and back.count() == df.count()


def test_unanswered_turns_stay(spark):
    rows = [(1, "q", None, None, None), (2, None, "a", None, None), (3, "q", "a", None, None), (4, None, None, None, [("user", None)]), (5, None, None, "s", None), (6, "q", None, "s", None), (7, None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, prompt string, response string, system string, messages array<struct<role:string,content:string>>")
    got = {r.id: ([tuple(t) for t in r.turns], r.mapped) for r in chat.canonical(df, keep=("id",)).collect()}
    assert got == {
        1: ([("user", "q"), ("assistant", "")], True), 2: ([("user", ""), ("assistant", "a")], True), 3: ([("user", "q"), ("assistant", "a")], True), 4: ([("user", "")], True),
        5: ([("system", "s"), ("user", ""), ("assistant", "")], True), 6: ([("system", "s"), ("user", "q"), ("assistant", "")], True), 7: ([], False),
    }


def test_archives_of_payloads_of_all_sizes(spark):
    pages = spark.createDataFrame([(i, "u", "x" * n) for i, n in enumerate([0, 5, 1 << 16, (1 << 16) + 1, 1 << 20, (1 << 20) + 1, 3_000_000, 3_000_000])], "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in arc.archive_and_read(pages).collect()}
    assert got == {i: (n, "revisit" if i == 7 else "response", 6 if i == 7 else None) for i, n in enumerate([0, 5, 1 << 16, (1 << 16) + 1, 1 << 20, (1 << 20) + 1, 3_000_000, 3_000_000])}
