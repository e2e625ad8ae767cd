"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; learned filters of 8 bytes slide over them with stride 4; activations are max-pooled over chunks
of 512 bytes that overlap by 128 and together cover the whole document; the chunks' maxima, averaged and maximised
over the document, are combined by a logistic layer into one probability.  Training (Adam, back-propagation through
the pooled positions) runs on the driver over a bounded hash-drawn sample of labelled rows; scoring runs over Arrow
buffers, in blocks of bounded size, over every byte of every text.

Defined results: null and empty texts are scored like a text of padding.  With no labelled row of either class every
score is 0.5.  Conflicting or repeated labels of one key count by their mean.  Rows are scored one by one, so
repeated rows and null ids pass through; other columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, frugal, groups_by_bytes, hash_fraction, spread, utf8

STRIDE, HALVES, BLOCK = 4, 2, 128  # a filter spans HALVES x STRIDE bytes; activations are first pooled by BLOCK bytes
CHUNK_BLOCKS, STEP_BLOCKS = 4, 3  # a chunk is 512 bytes and starts 384 after the last
_PER_BLOCK = BLOCK // STRIDE


@dataclass
class QualityNet:
    emb: np.ndarray  # 256 x e
    w: np.ndarray  # (HALVES * STRIDE * e) x filters
    b: np.ndarray
    out: np.ndarray  # 2 * filters
    bias: np.ndarray  # 1

    def parts(self) -> list[np.ndarray]:
        return [self.emb, self.w, self.b, self.out, self.bias]


def padded(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts side by side, each filled to whole blocks with zeros, which also stand before the first and after each text, so
    that no filter sees two texts; and the blocks of each."""
    lens, lead = np.diff(off), STRIDE * (HALVES - 1)
    blocks = -(-(lens + lead) // BLOCK)
    at = lead + np.concatenate([[0], np.cumsum(blocks * BLOCK)])
    buf = np.zeros(at[-1], np.uint8)
    buf[np.arange(len(raw)) + np.repeat(at[:-1] - off[:-1], lens)] = raw
    return buf, blocks


def block_maxima(net: QualityNet, buf: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Per block and filter the largest activation (and, for training, its position in the block)."""
    a = net.emb[buf].reshape(-1, STRIDE * net.emb.shape[1])
    half = net.w.shape[0] // HALVES
    z = a[:-1] @ net.w[:half]
    z += a[1:] @ net.w[half:]
    z = z.reshape(-1, _PER_BLOCK, net.w.shape[1])
    top = z.argmax(1) if where else None
    m = z.max(1) + net.b
    return np.maximum(m, 0, out=m), top


def chunk_starts(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First block of every chunk, and the chunks of each text."""
    n = np.maximum(1, -(-(blocks - (CHUNK_BLOCKS - STEP_BLOCKS)) // STEP_BLOCKS))
    first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    k = np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    return np.repeat(first, n) + STEP_BLOCKS * k, n


def combine(net: QualityNet, maxima: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, dict]:
    """Chunks' maxima over the document, and the probability's logit."""
    starts, n = chunk_starts(blocks)
    ends = np.repeat(np.cumsum(blocks), n)
    idx = np.minimum(starts[:, None] + np.arange(CHUNK_BLOCKS), ends[:, None] - 1)
    chunk = maxima[idx].max(1)
    at = np.concatenate([[0], np.cumsum(n)[:-1]])
    mean = np.add.reduceat(chunk, at, axis=0) / n[:, None]
    most = np.maximum.reduceat(chunk, at, axis=0)
    feats = np.concatenate([mean, most], axis=1)
    return feats @ net.out + net.bias[0], {"idx": idx, "chunk": chunk, "n": n, "at": at, "most": most, "feats": feats}


def logits(net: QualityNet, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Of each text.  A text beyond the block size runs its blocks through the filters piece by piece."""
    out = np.empty(len(off) - 1)
    for i, j in groups_by_bytes(off, BLOCK_BYTES // 2):
        part, o = raw[off[i] : off[j]], off[i : j + 1] - off[i]
        if len(part) <= BLOCK_BYTES:
            buf, blocks = padded(part, o)
            out[i:j] = combine(net, block_maxima(net, buf)[0], blocks)[0]
            continue
        buf, blocks = padded(part, o)
        step, tail = BLOCK_BYTES // 2, STRIDE * (HALVES - 1)
        maxima = np.concatenate([block_maxima(net, buf[k : k + step + tail])[0] for k in range(0, len(buf) - tail, step)])
        out[i:j] = combine(net, maxima, blocks)[0]
    return out


def train(samples: list[tuple[str, int]], *, e: int = 6, filters: int = 48, epochs: int = 12, batch: int = 16, rate: float = 4e-3, seed: int = 11) -> QualityNet:
    rng = np.random.default_rng(seed)
    net = QualityNet(rng.normal(0, 0.5, (256, e)).astype(np.float32), rng.normal(0, (2.0 / (HALVES * STRIDE * e)) ** 0.5, (HALVES * STRIDE * e, filters)).astype(np.float32), np.zeros(filters, np.float32), rng.normal(0, 0.05, 2 * filters).astype(np.float32), np.zeros(1, np.float32))
    y = np.array([q for _, q in samples], np.float32)
    if len(samples) == 0 or y.min() == y.max():
        net.out[:] = 0
        return net
    # spans of good texts are good: without them short texts, which fill few maxima, would pass for bad ones
    extra = [t[at : at + n] for t, q in samples if q == 1 and len(t) > 40 for n in [int(rng.integers(15, 200))] for at in [int(rng.integers(0, max(1, len(t) - n)))]][::2]
    raws = [np.frombuffer(t.encode(), np.uint8) for t in [*[t for t, _ in samples], *extra]]
    y = np.concatenate([y, np.ones(len(extra), np.float32)])
    weight = np.where(y == 1, 1.0, min(4.0, max(1.0, y.sum() / (len(y) - y.sum())) ** 0.5)).astype(np.float32)
    m1, m2 = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()]
    steps, t = epochs * -(-len(y) // batch), 0
    for _ in range(epochs):
        perm = rng.permutation(len(y))
        for i in range(0, len(perm), batch):
            rows = perm[i : i + batch]
            off = np.concatenate([[0], np.cumsum([len(raws[r]) for r in rows])])
            buf, blocks = padded(np.concatenate([raws[r] for r in rows]), off)
            maxima, top = block_maxima(net, buf, where=True)
            z, c = combine(net, maxima, blocks)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            g = ((p - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
            d_feats = g[:, None] * net.out
            d_out, d_bias = c["feats"].T @ g, np.array([g.sum()])
            owner = np.repeat(np.arange(len(rows)), c["n"])
            d_chunk = (d_feats[:, :filters] / c["n"][:, None])[owner]
            d_chunk = d_chunk + d_feats[:, filters:][owner] * (c["chunk"] == c["most"][owner])
            d_chunk *= c["chunk"] > 0
            which = maxima[c["idx"]].argmax(1)
            blk = np.take_along_axis(c["idx"], which, axis=1)
            pos = blk * _PER_BLOCK + np.take_along_axis(top, blk, axis=0)
            ch, fl = np.nonzero(d_chunk)
            dv = d_chunk[ch, fl]
            at = pos[ch, fl] * STRIDE
            byte = buf[at[:, None] + np.arange(HALVES * STRIDE)]
            patch = net.emb[byte].reshape(len(at), -1)
            d_w = np.zeros_like(net.w)
            order = np.argsort(fl, kind="stable")
            pv = patch * dv[:, None]
            if len(order):
                f_sorted = fl[order]
                cut = np.flatnonzero(np.concatenate([[True], f_sorted[1:] != f_sorted[:-1]]))
                d_w[:, f_sorted[cut]] = np.add.reduceat(pv[order], cut, axis=0).T
            d_b = d_chunk.sum(0)
            d_byte = (net.w.T[fl] * dv[:, None]).reshape(-1, e)
            flat = byte.reshape(-1)
            d_emb = np.stack([np.bincount(flat, d_byte[:, k], 256) for k in range(e)], axis=1)
            t += 1
            lr = rate * (1 - t / (steps + 1))
            for par, grad, a, b in zip(net.parts(), [d_emb, d_w, d_b, d_out, d_bias], m1, m2, strict=True):
                a += 0.1 * (grad - a)
                b += 0.01 * (grad * grad - b)
                par -= (lr * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return net


def sample_labelled(docs: DataFrame, labels: DataFrame, *, key: str, text: str, label: str, where: Column, per_class: int, span: int, seed: int) -> list[tuple[str, int]]:
    """About ``per_class`` texts of each class, drawn by a hash of the key: the drawn labels are few, whatever the
    tables' sizes, so they are broadcast to one scan of the documents.  A drawn text of more than ``span`` characters gives a
    span of that length, from anywhere in it."""
    marks = labels.where(where & F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg((F.avg(F.col(label)) >= 0.5).cast("int").alias("y"))
    counts = {r.y: r.n for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for g, n in counts.items() for x in (g, min(1.0, per_class / n))])
    drawn = marks.where(hash_fraction("k", seed) < share[F.col("y")])
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), spread(text, key, span, seed).alias("t"))
    return sorted((r.t, r.y) for r in rows.join(F.broadcast(drawn), "k").select("t", "y").collect())


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", where: Column | None = None, per_class: int = 1000, span: int = 50_000, seed: int = 11) -> QualityNet:
    """Trains on at most about ``per_class`` rows a class that satisfy ``where``."""
    return train(sample_labelled(docs, labels, key=key, text=text, label=label, where=F.lit(True) if where is None else where, per_class=per_class, span=span, seed=seed))


def score(docs: DataFrame, net: QualityNet, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, score (0 to 1), predicted (score >= 0.5)."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    plain = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            p = 1 / (1 + np.exp(-np.clip(logits(shared.value, *utf8(rb.column(1))), -30, 30))) if rb.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["__key", "score", "predicted"])

    return plain.mapInArrow(run, f"__key {plain.schema[0].dataType.simpleString()}, score double, predicted int").withColumnRenamed("__key", key)
