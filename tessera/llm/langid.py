"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the mean of the embeddings of its hashed 3- and 4-byte subwords (word boundaries included); a linear
softmax turns the mean into languages.  Both are trained together by stochastic gradient descent in numpy on a
bounded, hash-drawn sample of labelled rows.  Because mean and softmax layer are linear, scoring folds the two into
one table of class scores per bucket, so a text costs one table look-up per byte and order.

Rejection is calibrated: a class of scrambled text is learned beside the languages, a temperature is fitted on
labelled documents kept out of training, and a text is rejected if its probability of being in any language is under a
quarter of what all but ``reject_rate`` of those documents reach.  The score is the language's share among languages.

Defined results: null text, or text without a letter, gives ``und`` with score 0 (rejected).  With no labelled row
at all every text gives ``und``.  Of languages with equal scores the first in alphabetical order is given.  Texts of any
length are scored whole, in blocks of bytes.  Empty tables give empty results; rows are scored one by one, so repeated rows and
null ids pass through; columns other than id, text and label are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, frugal, hash_fraction, spread, utf8

UND = "und"
_BUCKET_BITS = 16
_BUCKETS = 1 << _BUCKET_BITS
_SPACE = 32

#: Letters keep their (lower-case) byte, bytes beyond ASCII stay, all else is a word boundary.
_FOLD = np.full(256, _SPACE, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_ASCII_LETTER = (_FOLD != _SPACE) & (np.arange(256) < 128)


@dataclass
class LangModel:
    langs: list[str]
    table: np.ndarray  # buckets x (languages + background + 1): class scores, and in the last column the weight
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, sums: np.ndarray) -> np.ndarray:
        """Of the languages and, last, of the background."""
        z = (sums[:, :-1] / np.maximum(sums[:, -1:], 1) + self.bias) / self.temperature
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(1, keepdims=True)


def _hashed(b: np.ndarray, width: int) -> np.ndarray:
    """Bucket of the subword at each position of folded bytes, the last width - 1 excepted; 0 for mere boundaries."""
    n = len(b) - width + 1
    x = b[:n].astype(np.uint32)
    for k in range(1, width):
        x = x * np.uint32(257) + b[k : n + k]
    x = ((x + np.uint32(width)) * np.uint32(2654435761)) >> np.uint32(32 - _BUCKET_BITS)
    x[(b[:n] == _SPACE) & (b[1 : n + 1] == _SPACE)] = 0
    return x


def bucket_sums(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray, block: int = BLOCK_BYTES) -> np.ndarray:
    """Sum of the table's rows over the subwords of each text; the bytes are taken in blocks, whatever the lengths."""
    out = np.zeros((len(offsets) - 1, table.shape[1]))
    total = int(offsets[-1])
    for lo in range(0, total, block):
        hi = min(lo + block, total)
        b = _FOLD[raw[lo : min(hi + 3, total)]]
        first, last = int(np.searchsorted(offsets, lo, side="right")) - 1, int(np.searchsorted(offsets, hi, side="left"))
        starts = np.maximum(offsets[first:last], lo) - lo
        lens = np.minimum(offsets[first + 1 : last + 1], hi) - lo - starts
        rows = np.flatnonzero(lens > 0)
        ends = offsets[first + 1 : last + 1] - lo
        for width in (3, 4):
            if len(b) < width:
                continue
            h = _hashed(b, width)[: hi - lo]
            for k in range(1, width):  # subwords that would run on into the next text
                e = ends - k
                h[e[(e >= 0) & (e < len(h))]] = 0
            v = np.zeros((hi - lo, table.shape[1]), np.float32)
            np.take(table, h, axis=0, out=v[: len(h)])
            out[first + rows] += np.add.reduceat(v, starts[rows], axis=0)
    return out


def _features(text: bytes) -> np.ndarray:
    b = _FOLD[np.frombuffer(text, np.uint8)]
    got = [_hashed(b, w) for w in (3, 4) if len(b) >= w]
    h = np.concatenate(got) if got else np.zeros(0, np.uint32)
    return h[h > 0]


def train(samples: list[tuple[str, str]], *, dim: int = 16, epochs: int = 6, span: int = 320, spans_per_text: int = 3, rate: float = 2.0, reject_rate: float = 0.001, seed: int = 7) -> LangModel:
    """SGD over short spans of the sampled texts; a fifth of the texts is kept out and calibrates."""
    rng = np.random.default_rng(seed)
    langs = sorted({lang for _, lang in samples})
    n_class = len(langs) + 1
    if not langs:
        return LangModel([], np.zeros((_BUCKETS, 2), np.float32), np.zeros(1), 1.0, 1.0)
    order = rng.permutation(len(samples))
    calibrate, fit = order[: len(order) // 5], order[len(order) // 5 :]
    if not len(calibrate):
        calibrate = fit
    xs, ys = [], []
    for i in fit:
        raw = samples[i][0].encode()
        for _ in range(spans_per_text if len(raw) > span else 1):
            at = int(rng.integers(0, max(1, len(raw) - span)))
            piece = raw[at : at + span]
            xs.append(_features(piece))
            ys.append(langs.index(samples[i][1]))
            if rng.random() < 0.5:  # a text keeps its language when a part of it is in another
                other = samples[int(rng.choice(fit))][0].encode()[: int(rng.integers(20, span * 9 // 10))]
                xs.append(_features(piece + b" " + other))
                ys.append(langs.index(samples[i][1]))
            if rng.random() < 0.12:  # scrambled text teaches the background
                noise = np.frombuffer(piece, np.uint8).copy()
                rng.shuffle(noise)
                if rng.random() < 0.5:
                    noise = rng.integers(33, 123, len(piece)).astype(np.uint8)
                xs.append(_features(noise.tobytes()))
                ys.append(n_class - 1)
    emb = rng.normal(0, 0.1, (_BUCKETS, dim)).astype(np.float32)
    w = np.zeros((dim, n_class), np.float32)
    bias = np.zeros(n_class, np.float32)
    y = np.array(ys)
    batch = 64
    steps = epochs * -(-len(xs) // batch)
    step = 0
    for _ in range(epochs):
        perm = rng.permutation(len(xs))
        for i in range(0, len(perm), batch):
            rows = [r for r in perm[i : i + batch] if len(xs[r])]
            if not rows:
                continue
            lr = rate * (1 - step / steps)
            step += 1
            idx = np.concatenate([xs[r] for r in rows])
            n = np.array([len(xs[r]) for r in rows])
            at = np.concatenate([[0], np.cumsum(n)[:-1]])
            mean = np.add.reduceat(emb[idx], at, axis=0) / n[:, None]
            z = mean @ w + bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            g = (p @ w.T) / n[:, None]
            w -= lr * (mean.T @ p)
            bias -= lr * p.sum(0)
            np.add.at(emb, idx, np.repeat((-lr * len(rows) * g).astype(np.float32), n, axis=0))
    table = np.concatenate([emb @ w, np.ones((_BUCKETS, 1), np.float32)], axis=1).astype(np.float32)
    table[0] = 0
    model = LangModel(langs, table, bias.astype(float), 1.0, 0.0)
    held = [samples[i][0].encode() for i in calibrate]
    truth = np.array([langs.index(samples[i][1]) for i in calibrate])
    off = np.concatenate([[0], np.cumsum([len(x) for x in held])])
    sums = bucket_sums(np.frombuffer(b"".join(held), np.uint8), off, table)

    def loss(t: float) -> float:
        model.temperature = t
        return -np.log(np.maximum(model.probabilities(sums)[np.arange(len(truth)), truth], 1e-9)).mean()

    model.temperature = min((2.0**k for k in np.arange(-3, 3.1, 0.25)), key=loss)
    model.threshold = 0.25 * float(min(1.0, np.quantile(1 - model.probabilities(sums)[:, -1], reject_rate)))
    return model


def sample_labelled(docs: DataFrame, *, text: str, lang: str, key: str, where: Column, per_lang: int, span: int, seed: int) -> list[tuple[str, str]]:
    """About ``per_lang`` rows of each language, drawn by a hash of the key in proportion to its count, so that the
    size is bounded by languages x per_lang whatever the table's size.  A drawn text of more than ``span`` characters gives
    a span of that length, from anywhere in it."""
    rows = docs.where(where & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), spread(text, key, span, seed).alias("t"), F.col(lang).alias("g"))
    counts = {r.g: r.n for r in rows.groupBy("g").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for g, n in counts.items() for x in (g, min(1.0, per_lang / n))])
    got = rows.where(hash_fraction("k", seed) < share[F.col("g")]).select("t", "g").collect()
    return sorted((r.t, r.g) for r in got)


def detect(docs: DataFrame, model: LangModel, *, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: key, ``keep``, lang_pred, score, rejected."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    plain = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"), *[F.col(c).alias(f"__keep{i}") for i, c in enumerate(keep)])
    fields = {f.name: f.dataType.simpleString() for f in plain.schema}
    kept = "".join(f", __keep{i} {fields[f'__keep{i}']}" for i in range(len(keep)))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for rb in batches:
            col = rb.column(1)
            raw, off = utf8(col)
            n = len(off) - 1
            letter = np.zeros(n, bool)
            hits = np.flatnonzero(_ASCII_LETTER[raw])
            letter[np.searchsorted(off, hits, side="right") - 1] = True
            for i in np.flatnonzero(~letter & (np.diff(off) > 0)):
                letter[i] = any(map(str.isalpha, raw[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace")))
            if m.langs:
                p = m.probabilities(bucket_sums(raw, off, m.table))
                known = 1 - p[:, -1]
                p = p[:, :-1] / np.maximum(p[:, :-1].sum(1, keepdims=True), 1e-12)
                best = p.argmax(1)
                score = np.where(letter, p[np.arange(n), best], 0.0)
                pred = [m.langs[b] if ok else UND for b, ok in zip(best, letter, strict=True)]
            else:
                score, pred, known = np.zeros(n), [UND] * n, np.zeros(n)
            rejected = ~letter | (known < m.threshold)
            arrays = [rb.column(0), *[rb.column(2 + i) for i in range(len(keep))], pa.array(pred, pa.string()), pa.array(score), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays(arrays, names=["__key", *[f"__keep{i}" for i in range(len(keep))], "lang_pred", "score", "rejected"])

    out = plain.mapInArrow(run, f"__key {fields['__key']}{kept}, lang_pred string, score double, rejected boolean")
    return out.withColumnsRenamed({"__key": key} | {f"__keep{i}": c for i, c in enumerate(keep)})


def fit(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", where: Column | None = None, per_lang: int = 1200, span: int = 50_000, seed: int = 7) -> LangModel:
    """Trains on at most about ``per_lang`` rows a language that satisfy ``where``."""
    return train(sample_labelled(docs, text=text, lang=lang, key=key, where=F.lit(True) if where is None else where, per_lang=per_lang, span=span, seed=seed))
