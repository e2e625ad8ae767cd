"""Language ID, quality, language model and media: held-out accuracy, brute force, edge cases."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import langid, lm, media, quality
from tessera.llm.common import crc_mod
from tessera.llm.queries import QUERIES, tokenizer_path

SF, SF2 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
RANKS = tokenizer_path("byte_bpe_50k.tiktoken")


# --- language ID --------------------------------------------------------------------------------------------------


def test_language_id_on_held_out_documents(spark):
    got = QUERIES["op1_language_id"](spark, SF2)
    docs = spark.read.parquet(f"{SF2}/documents.parquet").select("doc_id", "lang")
    held = got.where("held_out").join(docs, "doc_id")
    assert held.where("lang = lang_pred").count() / held.count() > 0.95
    assert got.where("rejected").count() <= 3 and got.where("score < 0 OR score > 1").count() == 0


def test_language_id_edge_cases(spark):
    model = langid.train([("der die das und nicht " * 9, "de"), ("the of and with this " * 9, "en")] * 30)
    rows = [(1, None, "x"), (2, "", "x"), (3, "12 - 34 !", "x"), (4, "the of and", "x"), (4, "the of and", "x"), (None, "und nicht", "x"), (7, "日本", "x"), (8, "the and of " * 400_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.detect(df, model).collect()]
    assert [(k, p) for k, p, _ in got] == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (None, "de"), (7, got[6][1]), (8, "en")]
    assert [s for *_, s in got[:3]] == [0, 0, 0] and got[6][1] in ("de", "en")
    assert langid.detect(df.limit(0), model).count() == 0
    none = langid.fit(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.detect(df, none).collect()} == {"und"}


def test_bucket_sums_do_not_depend_on_blocks_or_neighbours():
    rng = np.random.default_rng(0)
    table = rng.normal(0, 1, (1 << 16, 3)).astype(np.float32)
    table[0] = 0
    texts = [b"", b"a", b"ab", b"Abc d", "çé x".encode(), b"word " * 50, b"", b"zz"]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    raw = np.frombuffer(b"".join(texts), np.uint8)
    alone = np.array([table[langid._features(t)].sum(0) for t in texts])
    for block in (1, 7, 64, 10**6):
        assert np.allclose(langid.bucket_sums(raw, off, table, block), alone, atol=1e-3)


# --- quality ------------------------------------------------------------------------------------------------------


def test_quality_gradients_equal_differences():
    rng = np.random.default_rng(3)
    texts = ["abc def ghi " * 30, "x", "", "the quick brown fox " * 60]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    net = quality.QualityNet(rng.normal(0, 1, (256, 3)), rng.normal(0, 0.3, (24, 4)), rng.normal(0, 0.1, 4), rng.normal(0, 1, 8), np.zeros(1))
    z = quality.logits(net, raw, off)
    one = [quality.logits(net, np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert np.allclose(z, one)
    _, n = quality.chunk_starts(np.array([1, 4, 5, 7, 8, 40]))
    assert n.tolist() == [1, 1, 2, 2, 3, 13]  # chunks of 4 blocks, a new one every 3, up to the last block


def test_quality_of_a_text_beyond_the_block_size():
    rng = np.random.default_rng(3)
    net = quality.QualityNet(rng.normal(0, 1, (256, 3)).astype(np.float32), rng.normal(0, 0.3, (24, 4)).astype(np.float32), np.zeros(4, np.float32), rng.normal(0, 1, 8).astype(np.float32), np.zeros(1, np.float32))
    text = rng.integers(32, 127, 5_000_001).astype(np.uint8)
    buf, blocks = quality.padded(text, np.array([0, len(text)]))
    assert quality.logits(net, text, np.array([0, len(text)]))[0] == pytest.approx(quality.combine(net, quality.block_maxima(net, buf)[0], blocks)[0][0], abs=1e-3)


def test_quality_on_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF2}/labels.parquet")
    got = QUERIES["op2_quality"](spark, SF2).where("held_out").join(labels, "doc_id").collect()
    y, s = np.array([r.quality for r in got]), np.array([r.score for r in got])
    pairs = (s[y == 1][:, None] > s[y == 0][None]).mean()
    assert pairs > 0.9 and len(got) > 80


def test_quality_edge_cases(spark):
    rows = [(1, None, 0.0), (2, "", 0.0), (3, "x" * 700_000, 0.0), (None, "a", 0.0), (4, "a", 0.0), (4, "a", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    net = quality.fit(df, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r.score for r in quality.score(df, net).collect()] == [0.5] * 6
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, 0), (4, 1), (None, 1)], "doc_id long, quality int")
    got = quality.score(df, quality.fit(df, labels)).collect()
    assert got[0].score == got[1].score and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert quality.score(df.limit(0), net).count() == 0


# --- language model -----------------------------------------------------------------------------------------------


def brute_base(rows, train):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for i, t in rows}
    count, n = {}, 0
    for i, _ in rows:
        if i in train:
            for w in [*words[i], None]:
                count[w] = count.get(w, 0) + 1
                n += 1
    v = len(count)
    return {i: (len(ws) + 1, sum(w in count for w in [*ws, None]), n, sum(math.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in [*ws, None])) for i, ws in words.items()}


@pytest.mark.parametrize("heavy", [0, 3, 300_000])
def test_base_scores_equal_brute_force(spark, heavy):
    rng = np.random.default_rng(1)
    vocab = ["The", "the", "of", "Éa", "x\x00y", "rare1", "q\x85z", "w."]
    rows = [(i, " ".join(rng.choice(vocab, rng.integers(0, 30)))) for i in range(60)] + [(100, None), (101, ""), (102, "unseen words here"), (103, "the " * 50_000)]
    train = {i for i, _ in rows if i < 50}
    df = spark.createDataFrame([(i, t, 0, "u") for i, t in rows], "doc_id long, text string, n int, word string").repartition(3)
    model, counts = lm.fit(df, RANKS, where=F.col("doc_id") < 50, heavy=heavy, steps=5)
    got = {r.doc_id: r for r in lm.score(df, model, counts).collect()}
    for i, (n, known, total, base) in brute_base(rows, train).items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total), i
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0


def test_lm_without_training_rows_or_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    model, counts = lm.fit(df, RANKS, where=F.lit(False))
    got = lm.score(df, model, counts).collect()
    assert len(got) == 3 and all(r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in got)
    assert lm.score(df.limit(0), model, counts).count() == 0


def _tiny(vocab=40, classes=5, seed=0, steps=20):
    rng = np.random.default_rng(seed)
    sizes = [rng.integers(1, 4, rng.integers(0, 40)) for _ in range(20)]
    texts = [rng.integers(0, vocab - 1, n.sum()) for n in sizes]
    cls = lm.classify(texts, vocab, classes, vocab - 1, rng)
    cells = rng.integers(0, 9, (classes + 1, vocab)).astype(float)
    net = lm.network(cls, cells, rng.integers(0, 9, vocab).astype(float), rng.integers(0, 5, vocab).astype(float), dim=6, hidden=8, window=8, stride=6, slots=16, rng=rng)
    ids, n = np.concatenate([np.append(t, vocab - 1) for t in texts]), np.concatenate([np.append(k, 1) for k in sizes])
    w = lm.Words.of(ids, n, np.array([len(k) + 1 for k in sizes]), vocab - 1)
    return lm.train(net, w, steps=steps, batch=8) if steps else net, w, texts, sizes


def plain_scores(net, ids, sizes):
    """Log probabilities of the words of one text, word by word in loops; the last word is the end."""
    p, d, out, at = net.params, net.params["E"].shape[1], [], 0
    words = []
    for n in sizes:
        words.append([int(x) for x in ids[at : at + n]])
        at += n
    soft = lambda z: np.log(np.exp(z) / np.exp(z).sum())
    for place, word in enumerate(words):
        k = 0 if place < net.window else -(-(place - net.window + 1) // net.stride)  # the first window that holds the word
        x = [np.mean([p["E"][net.slot[i]] for i in (words[q - 1] if q else [net.end])], axis=0) + p["P"][q - k * net.stride] for q in range(k * net.stride, place + 1)]
        q, *_ = np.split(x[-1] @ p["qkv"], 3)
        keys, values = [v @ p["qkv"][:, d : 2 * d] for v in x], [v @ p["qkv"][:, 2 * d :] for v in x]
        a = np.exp([q @ key * d**-0.5 for key in keys])
        h = x[-1] + (a[:, None] * values).sum(0) / a.sum() @ p["o"]
        z = (h + np.maximum(h @ p["w1"] + p["b1"], 0) @ p["w2"]) @ p["u"] + p["c"]
        first = soft(z)[net.cls[word[0]]] + net.inside[-1, word[0]]
        rest = net.end_here[word[-1]]
        for last, i in zip(word, word[1:]):
            rest += net.go_on[last] + soft(z + p["S"][net.cls[last]])[net.cls[i]] + net.inside[net.cls[last], i]
        out.append((first, rest))
    return np.array(out)


def test_scores_equal_plain_loops():
    net, w, texts, sizes = _tiny()
    first, rest = lm.word_scores(net, w, batch=3)
    want = np.concatenate([plain_scores(net, np.append(t, 39), np.append(n, 1)) for t, n in zip(texts, sizes, strict=True)])
    assert np.allclose(first, want[:, 0], atol=1e-4) and np.allclose(rest, want[:, 1], atol=1e-4)


def test_words_encoded_together_equal_words_encoded_alone():
    of, rng = lm.subwords(RANKS), np.random.default_rng(4)
    pool = ["the", "it's", "'s", "x\u00a0", "\u00a0y", "\u2003", "a\x1cb", "\x85", "\x00", "Éa", "日本語", "12,5", "!!", "_", "z" * 300]
    words = [pool[i].encode() for i in rng.integers(0, len(pool), 200)] + [bytes(rng.integers(33, 256, k, dtype=np.uint8)) for k in rng.integers(1, 9, 200)]
    plain = [w for w in words if w.isascii() and w.isalnum()]
    for some in (words, plain, words[:1], []):
        alone = [of(w) for w in some]
        for at_once in (1, 7, 1000):
            ids, n = of.many(some, at_once)
            assert n.tolist() == [len(x) for x in alone] and ids.tolist() == [i for x in alone for i in x]


def test_vectors_are_means_for_words_of_any_length():
    rng = np.random.default_rng(3)
    p, slot = {"E": rng.normal(size=(50, 4)).astype(np.float32)}, rng.integers(0, 50, 90)
    for sizes in ([1], [1, 2, 1], [8, 9, 1, 40], [7, 8], [300], []):
        ids = rng.integers(0, 90, sum(sizes))
        want, at = [], 0
        for n in sizes:
            want.append(p["E"][slot[ids[at : at + n]]].mean(0))
            at += n
        got = lm.vectors(p, slot, ids, np.array(sizes, np.int64))
        assert np.allclose(got, np.array(want).reshape(-1, 4), atol=1e-5)


def test_probabilities_sum_to_one():
    net, w, _, _ = _tiny()
    z, _ = lm.forward(net.params, lm.vectors(net.params, net.slot, w.ids, w.sizes)[None, :8])
    for state in range(len(net.inside)):
        s = z + (net.params["S"][state] if state < len(net.inside) - 1 else 0)
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        assert np.allclose((p[:, net.cls] * np.exp(net.inside[state])[None]).sum(1), 1, atol=1e-4)
    assert np.allclose(np.exp(net.end_here) + np.exp(net.go_on), 1)


def test_each_word_is_scored_once():
    net, w, _, _ = _tiny()
    idx, there, scored = lm.windows(w.lens, net.window, net.stride)
    assert sorted(idx[scored].tolist()) == list(range(w.lens.sum())) and not (scored & ~there).any()


def test_lm_gradients_equal_differences():
    net, w, _, _ = _tiny(steps=0)
    rng = np.random.default_rng(1)
    net.params.update({k: (v + rng.normal(0, 0.1, v.shape)).astype(float) for k, v in net.params.items()})
    idx, there, _ = lm.windows(w.lens, net.window, net.window)
    _, g = lm.gradients(net, w, idx[:6], there[:6])
    rows, grad = g["E"]
    g["E"] = np.zeros_like(net.params["E"])
    g["E"][rows] = grad
    for k, v in net.params.items():
        for at in rng.integers(0, v.size, 5):
            loss = []
            for step in (1e-5, -1e-5):
                v.flat[at] += step
                loss.append(lm.gradients(net, w, idx[:6], there[:6])[0])
                v.flat[at] -= step
            assert np.ravel(g[k])[at] == pytest.approx((loss[0] - loss[1]) / 2e-5, abs=1e-6), (k, at)


def test_model_is_better_than_the_base(spark):
    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    held = crc_mod("doc_id", 7) == 2
    model, counts = lm.fit(docs, RANKS, where=~held, steps=300)
    rows = lm.score(docs.where(held), model, counts).collect()
    total = lambda c: sum(r[c] for r in rows)
    assert total("score") > total("base_score") and sum(r.score > r.base_score for r in rows) > 0.8 * len(rows)
    assert total("spelled_score") / total("n_tokens") > -4.6  # with words that training never saw spelled out


def test_every_training_document_moves_the_weights(spark):
    """Beyond the sample, too: other text in documents that were not drawn changes the network."""
    rows = [(i, f"word{i % 7} and some more words of document {i % 13} " * 20) for i in range(60)]
    fits = []
    for last in ("plain words at the end", "quite other things stand here " * 30):
        df = spark.createDataFrame([*rows, (60, last)], "doc_id long, text string").repartition(2)
        fits.append(lm.fit(df, RANKS, where=F.lit(True), sample_docs=1, steps=3)[0].net.params)
    assert any(not np.allclose(fits[0][k], fits[1][k]) for k in ("qkv", "u", "w1"))


def test_training_sees_every_window(spark, monkeypatch):
    """The tasks learn from each word of every text, and its end, once: counted here in the function that they run."""
    texts = ["", " ".join(f"w{i}" for i in range(700)), " ".join(f"v{i}" for i in range(32)), None, "x " * 9999]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    runs, seen, learn, spark_map = [], [], lm.gradients, type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda d, run, schema, *a, **k: (runs.append((schema, run)), spark_map(d, run, schema, *a, **k))[1])
    lm.fit(df, RANKS, where=F.lit(True), steps=1)
    monkeypatch.setattr(lm, "gradients", lambda net, w, idx, there: (seen.append(int(there.sum())), learn(net, w, idx, there))[1])
    (run,) = [run for schema, run in runs if schema.startswith("j long")]
    list(run(iter(df.select("text").toArrow().to_batches())))
    assert sum(seen) == sum(len((t or "").split()) + 1 for t in texts)


def test_repeated_rows_and_long_texts(spark):
    long = "some words that repeat " * 60_000
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "b a c"), (None, "a b"), (None, "zz"), (2, long)], "doc_id long, text string")
    model, counts = lm.fit(df, RANKS, where=F.lit(True), steps=3, window=8, stride=6)
    got = sorted(((r.doc_id or 0, r.n_tokens, r.n_known, round(r.score, 6)) for r in lm.score(df.repartition(3), model, counts).collect()))
    alone = sorted(((r.doc_id or 0, r.n_tokens, r.n_known, round(r.score, 6)) for d in (df.where("doc_id IS NULL"), df.where("doc_id = 1"), df.where("doc_id = 2")) for r in lm.score(d, model, counts).collect()))
    assert len(got) == 6 and [x[:3] for x in got] == [x[:3] for x in alone]
    assert all(a[3] == pytest.approx(b[3], rel=1e-5) for a, b in zip(got, alone, strict=True))


# --- media --------------------------------------------------------------------------------------------------------


def _picture(seed, size=64):
    rng = np.random.default_rng(seed)
    v = rng.normal(0, 0.125, 64)
    return np.clip(128 + 90 * (v @ media._waves(64, 64)) / np.sqrt((v**2).mean() * 32), 0, 255).astype(np.uint8).reshape(64, 64)


def test_edited_copies_share_a_class_and_others_do_not(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    edits = [lambda x: x, lambda x: x[6:58, 9:61], lambda x: np.clip(x + rng.normal(0, 4, x.shape), 0, 255), lambda x: x * 0.8 + 12, np.rot90, lambda x: np.where(np.arange(64)[None] < 14, 0, x)]
    for s in range(25):
        for k, e in enumerate(edits if s < 12 else edits[:1]):
            key = 100 * k + s
            rows.append((key, media.encode(np.asarray(e(_picture(s))).astype(np.uint8)), "x", "y"))
            want[key] = s
    rows += [(900, None, "x", "y"), (901, b"no image", "x", "y"), (902, b"no image", "x", "y"), (903, media.encode(np.zeros((4, 4))), "x", "y"), (904, media.encode(np.zeros((300, 300))), "x", "y"), (0, rows[0][1], "x", "y"), (None, rows[0][1], "x", "y")]
    df = spark.createDataFrame(rows, "media_id long, image binary, id string, root string").repartition(3)
    got = [(r.media_id, r.component_id, r.n_keypoints) for r in media.copies(df).collect()]
    assert len(got) == len(rows)
    by = {k: c for k, c, _ in got}
    found = sum(by[k] == c for k, c in want.items())
    assert found / len(want) >= 0.97 and all(by[k] % 100 == c for k, c in want.items())
    assert (by[900], by[901], by[902], by[903], by[904], by[None]) == (900, 901, 901, 903, 904, 0)
    assert media.copies(df.limit(0)).count() == 0


def test_links_equal_brute_force_on_a_fixture(spark):
    """A group of near copies larger than any leader's first round, against consensus of all pairs."""
    rng = np.random.default_rng(6)
    pics = [_picture(s) for s in range(6)] + [np.clip(_picture(99) + rng.normal(0, 3, (64, 64)), 0, 255).astype(np.uint8) for _ in range(30)]
    kp = [media.describe(p[None])[1:] for p in pics]  # coordinates come first
    label = list(range(len(pics)))
    for i in range(len(pics)):
        for j in range(i):
            if media.consensus(*kp[j], *kp[i]):
                label[i] = min(label[i], label[j])
    df = spark.createDataFrame([(i, media.encode(p)) for i, p in enumerate(pics)], "media_id long, image binary")
    got = {r.media_id: r.component_id for r in media.copies(df).collect()}
    assert np.mean([got[i] == label[i] for i in range(len(pics))]) >= 0.9


def test_recall_and_precision_of_the_registered_query(spark):
    """Every row whose id is divisible by 20 has an edited copy among all rows."""
    got = {r.vec_id: r.component_id for r in QUERIES["op5_media"](spark, SF2).collect()}
    asked = [k for k in got if k >= 0 and k % 20 == 0]
    found = [k for k in asked if got[k] == got[-1 - k] == -1 - k]
    others = [k for k in got if k >= 0 and k % 20 and got[k] != k]
    print(len(found), len(asked), len(others))
    assert len(found) >= 0.9 * len(asked) and len(others) <= 0.02 * len(got)


@pytest.mark.parametrize("alone", [1, 7])
def test_copies_behind_unrelated_leaders_of_a_bucket(spark, monkeypatch, alone):
    """One bucket for all images: unrelated ones lead the rounds, two copies come last; then six groups of copies."""
    true = media.keypoints
    monkeypatch.setattr(media, "keypoints", lambda *a, **k: true(*a, **k).withColumn("words", F.array(F.lit(1).cast("long"))))
    pics = [_picture(s) for s in range(alone)] + [_picture(50), (_picture(50) * 0.9 + 8).astype(np.uint8)]
    if alone > 1:
        pics += [x for s in range(60, 66) for x in (_picture(s), (_picture(s) * 0.9 + 8).astype(np.uint8))]
    want = {i: i - ((i - alone) % 2 if i >= alone else 0) for i in range(len(pics))}
    df = spark.createDataFrame([(i, media.encode(p)) for i, p in enumerate(pics)], "media_id long, image binary")
    assert {r.media_id: r.component_id for r in media.copies(df).collect()} == want


def _classes(pics, votes=0):
    """Smallest index reachable by pairs with consensus and ``votes`` common words, over all pairs."""
    kp = [media.describe(np.ascontiguousarray(p)[None])[1:] for p in pics]
    words = [set(media.table_words(d).tolist()) if len(d) else set() for _, d in kp]
    label = list(range(len(pics)))
    for _ in pics:
        for i in range(len(pics)):
            for j in range(i):
                if len(words[i] & words[j]) >= votes and media.consensus(*kp[j], *kp[i]):
                    label[i] = label[j] = min(label[i], label[j])
    return label


def _found(spark, pics, **how):
    df = spark.createDataFrame([(i, media.encode(p)) for i, p in enumerate(pics)], "media_id long, image binary")
    got = {r.media_id: r.component_id for r in media.copies(df, **how).collect()}
    return [got[i] for i in range(len(pics))]


def test_a_copy_of_the_leaders_copy_is_linked(spark, monkeypatch):
    """In one bucket: two parts that have nothing in common, and the whole, which both are cropped from."""
    true = media.keypoints
    monkeypatch.setattr(media, "keypoints", lambda *a, **k: true(*a, **k).withColumn("words", F.array(F.lit(1).cast("long"))))
    for x in map(_picture, (3, 4)):
        pics = [x[:, :42], x, x[:, 22:]]
        assert _classes(pics) == [0, 0, 0] and _classes([pics[0], pics[2]]) == [0, 1]
        assert _found(spark, pics) == _found(spark, [pics[2], pics[1], pics[0]]) == [0, 0, 0]


def test_votes_in_all_buckets(spark):
    """``votes`` common words are counted over all rounds; none asked for, every pair is verified."""
    rng = np.random.default_rng(8)
    pics = [np.clip(_picture(s) + rng.normal(0, k, (64, 64)), 0, 255).astype(np.uint8) for s in range(5) for k in (0, 6, 12, 20, 30)]
    assert _classes(pics, 0) != _classes(pics, 1) != _classes(pics, 6)
    for votes in (0, 1, 6):
        assert _found(spark, pics, votes=votes) == _classes(pics, votes)


def test_images_of_repeated_and_null_keys_are_linked(spark):
    near = lambda s: media.encode((_picture(s) * 0.9 + 8).astype(np.uint8))
    far = lambda s: media.encode(_picture(s))
    rows = [(1, far(70)), (1, far(71)), (1, far(72)), (2, near(70)), (3, near(71)), (4, near(72)), (5, far(73)), (None, near(73)), (None, far(74)), (None, b"x")]
    got = media.copies(spark.createDataFrame(rows, "media_id long, image binary")).collect()
    assert sorted((r.media_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 0), (0, 5), (1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, 5)]


def test_decoding():
    x = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert (media.decode(media.encode(x)) == x).all()
    for bad in (None, b"", b"P5\n4 3\n255\n123", b"P6\n1 1\n255\nxxx", b"P5\n0 3\n255\n", b"P5\n1 1\n65535\nxx"):
        assert media.decode(bad) is None
