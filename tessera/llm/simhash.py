"""SimHash near-duplicate detection with BK-trees.

Fingerprint: A-Z lower-cased, words split at ASCII white space, shingles of ``width`` words hashed with XXH64 (seed 42); a
bit is 1 if set in over half the hashes.  Texts of fewer words have one shingle, all of it; texts without words (null
texts too) have fingerprint zero and are linked like any other.

``near_duplicates`` links fingerprints (shingles of 3 words, repeats included) within ``radius`` bits.  The 64 bits are cut
into ``blocks`` blocks; two fingerprints that differ in at most ``radius`` bits agree on at least ``blocks - radius``
whole blocks, so for some choice of that many blocks they fall into the same shard, exactly.  A shard of over ``limit``
fingerprints is split in the same way by the bits that it leaves free, so that none outgrows a task: after three levels 14
bits are free, and 2^14 fingerprints are all there can be.  Every shard gets a BK-tree, whose children are keyed by
their integer Hamming distance to the parent; a search follows only the edges within the radius.  Shard trees stay in
the task that holds the shard: to broadcast them, the driver would have to gather the fingerprints of all
documents, which has no size bound.  A shard's links are reduced to its components before they leave the task, so a
group of n near copies gives n - 1 rows and never all its pairs.  Equal fingerprints are one node from the start.

``deduplicate`` keeps one row of each group of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or
more.  At that similarity fingerprints differ in some ten bits, more than blocks of bits can find, so shards are named
by minima of the shingles' hashes instead: of ``SHARDS`` names, each made of ``ROWS`` minima, two texts of similarity s
share none with probability (1 - s^5)^20: 0.0004 at 0.8, 0.00001 at 0.85.  In a shard BK-trees find each fingerprint's nearest
within ``reach`` bits (at 0.8 more than 24 bits differ with probability 0.00001), and every such pair is checked exactly.
The groups so found stay in shards
that still hold several; there the texts outside the shard's largest group are compared exactly with all texts of other
groups within reach, their sets at hand, and only links that join groups leave the task.  Shards of many texts are
searched in slices, and those texts visit all slices of their shard.

Components are found by alternating large-star and small-star rounds, each cut by a checkpoint in the shared folder.

Defined results: near_duplicates gives one row per input row, so repeated rows come back as often; component_id is the smallest
non-null key among reachable rows (null if all are null).  deduplicate tells rows apart by key and text: rows that repeat both
are one, other texts with the same key, or without one, are judged by themselves; of a group stays the row with the
smallest key (nulls last), ties by the hash of the text.  Texts of any length are processed whole.  Other columns are
ignored by the first and kept by the second.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import checkpoint, components
from .common import broadcast_if, frugal, groups_by_bytes, utf8

SHINGLE, SEED = 3, 42
WIDTH, ROWS, SHARDS = 5, 5, 20

_rng = np.random.default_rng(192)
_MASK = _rng.integers(0, 1 << 63, ROWS * SHARDS, dtype=np.uint64)
_TIMES = _rng.integers(0, 1 << 63, ROWS * SHARDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: bytes, width: int = SHINGLE) -> list[int]:
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], SEED) for s, e in zip((ends - lens)[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)]


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For runs of ``counts`` hashes each, the 64 bits set in over half of the run; 0 for an empty run."""
    out = np.zeros(len(counts), np.uint64)
    at = np.concatenate([[0], np.cumsum(counts)[:-1]])
    full = np.flatnonzero(counts > 0)
    if not len(full):
        return out
    parts = -(-counts[full] // 255)  # so that sums of bits fit one byte each
    owner = np.repeat(np.arange(len(full)), parts)
    k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    cuts = at[full][owner] + 255 * k
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.add.reduceat(bits.view(np.uint64), cuts, axis=0).view(np.uint8).astype(np.int64)
    total = np.add.reduceat(sums, np.cumsum(parts) - parts, axis=0)
    set_ = (2 * total > counts[full][:, None]).astype(np.uint8)
    out[full] = np.packbits(set_, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprint_many(items: list[bytes]) -> np.ndarray:
    hashes = [shingle_hashes(t) for t in items]
    counts = np.fromiter(map(len, hashes), np.int64, len(hashes))
    flat = np.fromiter((h for hs in hashes for h in hs), np.uint64, int(counts.sum()))
    return majority_bits(flat, counts)


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp long): one row per row of docs."""
    plain = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            raw, off = utf8(rb.column(1))
            data, fps = raw.tobytes(), np.zeros(rb.num_rows, np.uint64)
            for i, j in groups_by_bytes(off, 1 << 20):
                fps[i:j] = fingerprint_many([data[off[r] : off[r + 1]] for r in range(i, j)])
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(fps.view(np.int64))], names=["__key", "fp"])

    return plain.mapInArrow(run, f"__key {plain.schema[0].dataType.simpleString()}, fp long").withColumnRenamed("__key", key)


# --- BK-trees ---------------------------------------------------------------------------------------------------


class BKForest:
    """BK-trees over runs of distinct fingerprints, one tree a run, built and searched level by level."""

    def __init__(self, fps: np.ndarray, root_of: np.ndarray) -> None:
        """root_of: for each fingerprint the index of its run's first, which becomes the root."""
        n = len(fps)
        self.fps, self.root = fps, root_of
        self.parent, self.edge = np.arange(n), np.zeros(n, np.int64)
        items = np.flatnonzero(root_of != np.arange(n))
        at = root_of[items]
        while len(items):
            d = np.bitwise_count(fps[items] ^ fps[at]).astype(np.int64)
            slot = at * 65 + d
            order = np.argsort(slot, kind="stable")
            first = np.concatenate([[True], slot[order][1:] != slot[order][:-1]])
            child = np.empty(len(items), np.int64)  # the first of each (node, distance) becomes the child there
            child[order] = items[order][np.flatnonzero(first)[np.cumsum(first) - 1]]
            new = child == items
            self.parent[items[new]], self.edge[items[new]] = at[new], d[new]
            items, at = items[~new], child[~new]
        kids = np.flatnonzero(self.parent != np.arange(n))
        order = np.lexsort((self.edge[kids], self.parent[kids]))
        self.kids = kids[order]
        self._key = self.parent[self.kids] * 65 + self.edge[self.kids]

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) of the same tree at most ``radius`` apart, a level of the trees at a time."""
        q, node = queries, self.root[queries]
        while len(q):
            d = np.bitwise_count(self.fps[q] ^ self.fps[node]).astype(np.int64)
            near = (d <= radius) & (q != node)
            if near.any():
                yield q[near], node[near]
            lo = np.searchsorted(self._key, node * 65 + np.maximum(d - radius, 0), side="left")
            hi = np.searchsorted(self._key, node * 65 + np.minimum(d + radius, 64), side="right")
            n = hi - lo
            q = np.repeat(q, n)
            node = self.kids[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(len(q))]


def _settle(label: np.ndarray) -> np.ndarray:
    while True:
        nxt = label[label]
        if (nxt == label).all():
            return label
        label = nxt


def forest_components(forest: BKForest, radius: int, block: int = 2048) -> np.ndarray:
    """For each fingerprint the index of a representative of its component inside its tree."""
    n = len(forest.fps)
    label = _settle(np.where(forest.edge <= radius, forest.parent, np.arange(n)))
    for i in range(0, n, block):
        for q, node in forest.within(np.arange(i, min(i + block, n)), radius):
            a, b = label[q], label[node]
            differ = a != b
            if not differ.any():
                continue
            for x, y in np.unique(np.stack([a[differ], b[differ]], axis=1), axis=0).tolist():
                while label[x] != x:
                    x = label[x]
                while label[y] != y:
                    y = label[y]
                label[max(x, y)] = min(x, y)
            label = _settle(label)
    return label


# --- shards -----------------------------------------------------------------------------------------------------


def shard_masks(blocks: int, radius: int, free: int = (1 << 64) - 1) -> list[int]:
    """Bits of each choice of blocks - radius blocks of the free bits."""
    bits = [i for i in range(64) if free >> i & 1]
    cut = [len(bits) * i // blocks for i in range(blocks + 1)]
    of = [sum(1 << b for b in bits[cut[i] : cut[i + 1]]) for i in range(blocks)]
    return [sum(of[i] for i in c) for c in combinations(range(blocks), blocks - radius)]


def _signed(m: int) -> int:
    return m - (1 << 64) if m >> 63 else m


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Whether each row begins a run of equal values."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def whole_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of sorted batches, cut so that rows with equal first ``keys`` columns stay together."""
    held: list[list[np.ndarray]] = []
    for rb in batches:
        got = [c.to_numpy(zero_copy_only=False) for c in rb.columns]
        if not rb.num_rows:
            continue
        begins = np.flatnonzero(_runs(*got[:keys]))
        joins = bool(held) and all(h[-1] == g[0] for h, g in zip(held[-1][:keys], got[:keys], strict=True))
        if held and not joins:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held = []
        last = begins[-1]
        if last:
            held.append([g[:last] for g in got])
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held = []
        held.append([g[last:] for g in got])
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def sharded(distinct: DataFrame, *, radius: int, blocks: int, limit: int, levels: int = 3) -> DataFrame:
    """(t, v, fp): the fingerprints in their shards, t numbers the choice of bits and v has their values."""
    masks = shard_masks(blocks, radius)
    named = lambda i, m: F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("v"))
    rows = distinct.select("fp", F.explode(F.array(*[named(i, m) for i, m in enumerate(masks)])).alias("s")).select("s.t", "s.v", "fp")
    done, base = None, 0
    for _ in range(levels - 1):
        hot = checkpoint(rows.groupBy("t", "v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("t", "v"))
        if hot.isEmpty():
            break
        cool = rows.join(hot, ["t", "v"], "left_anti")
        done = cool if done is None else done.unionByName(cool)
        finer = [shard_masks(blocks, radius, ((1 << 64) - 1) ^ m) for m in masks]
        table = F.array(*[F.array(*[F.lit(_signed(m | x)) for x in sub]) for m, sub in zip(masks, finer, strict=True)])
        next_base = base + len(masks)
        sub = F.posexplode(F.get(table, F.col("t") - base)).alias("u", "m")
        rows = rows.join(hot, ["t", "v"], "left_semi").select("t", "fp", sub)
        rows = rows.select((F.lit(next_base) + (F.col("t") - base) * len(finer[0]) + F.col("u")).alias("t"), F.col("fp").bitwiseAND(F.col("m")).alias("v"), "fp")
        masks, base = [m | x for m, sub in zip(masks, finer, strict=True) for x in sub], next_base
    return rows if done is None else done.unionByName(rows)


def shard_links(distinct: DataFrame, *, radius: int, blocks: int, limit: int = 50_000) -> DataFrame:
    """(a, b): links that join the fingerprints of ``distinct`` (one column fp) into their components."""
    rows = sharded(distinct, radius=radius, blocks=blocks, limit=limit).repartition("t", "v").sortWithinPartitions("t", "v")

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, v, fp in whole_runs(batches, 2):
            first = np.flatnonzero(_runs(t, v))
            size = np.diff(np.concatenate([first, [len(t)]]))
            many = np.repeat(size > 1, size)
            if not many.any():
                continue
            root = np.repeat(first, size)[many]
            index = np.cumsum(many) - 1
            s = np.ascontiguousarray(fp[many])
            label = forest_components(BKForest(s.view(np.uint64), index[root]), radius)
            own = label != np.arange(len(label))
            yield pa.RecordBatch.from_arrays([pa.array(s[own]), pa.array(s[label[own]])], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def fingerprint_roots(fps: DataFrame, low: Column, *, radius: int, blocks: int, limit: int) -> DataFrame:
    """(fp, low, root): each fingerprint with ``low`` over its rows, and the smallest fingerprint of its component."""
    distinct = fps.groupBy("fp").agg(low.alias("low"))
    member = components(shard_links(distinct.select("fp"), radius=radius, blocks=blocks, limit=limit))
    return distinct.join(member, distinct.fp == member.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", radius: int = 3, blocks: int = 5, limit: int = 50_000) -> DataFrame:
    """Per row of docs: key, fingerprint (16 hexadecimal digits), component_id."""
    fps = checkpoint(fingerprints(docs, key=key, text=text))
    rooted = fingerprint_roots(fps, F.min(key), radius=radius, blocks=blocks, limit=limit)
    low = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = rooted.join(low, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- one row of each group --------------------------------------------------------------------------------------


def shingle_set(text: bytes) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, WIDTH), np.uint64))


def shard_names(sets: list[np.ndarray]) -> np.ndarray:
    """For each set, none of them empty, the names of its shards."""
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    low = np.stack([np.minimum.reduceat((flat ^ m) * t, at) for m, t in zip(_MASK, _TIMES, strict=True)], axis=1)
    data = np.ascontiguousarray(low).tobytes()
    step = 8 * ROWS
    return np.array([xxhash.xxh64_intdigest(data[k : k + step], i % SHARDS) for i, k in enumerate(range(0, len(data), step))], np.uint64).reshape(-1, SHARDS).view(np.int64)


def sketches(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: __key, h (hash of the text), node (hash of its set), fp (the set's fingerprint), size of the set, shard names."""
    plain = docs.select(F.col(key).alias("__key"), F.xxhash64(text).alias("h"), F.col(text).alias("__text"))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            raw, off = utf8(rb.column(2))
            data = raw.tobytes()
            nodes, fps, sizes = (np.zeros(rb.num_rows, k) for k in (np.uint64, np.uint64, np.int32))
            words = [[]] * rb.num_rows
            for i, j in groups_by_bytes(off, 1 << 20):
                sets = [shingle_set(data[off[r] : off[r + 1]]) for r in range(i, j)]
                nodes[i:j] = [xxhash.xxh64_intdigest(s.tobytes()) for s in sets]
                sizes[i:j] = [len(s) for s in sets]
                fps[i:j] = majority_bits(np.concatenate(sets), sizes[i:j].astype(np.int64))
                full = [r for r in range(i, j) if sizes[r]]
                for r, w in zip(full, shard_names([s for s in sets if len(s)]) if full else (), strict=True):
                    words[r] = w
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(nodes.view(np.int64)), pa.array(fps.view(np.int64)), pa.array(sizes), pa.array(words, pa.list_(pa.int64()))], names=["__key", "h", "node", "fp", "size", "words"])

    return plain.mapInArrow(run, f"__key {plain.schema[0].dataType.simpleString()}, h long, node long, fp long, size int, words array<long>")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(node, set) from (node, text)."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            raw, off = utf8(rb.column(1))
            for i, j in groups_by_bytes(off, 1 << 20):
                data = raw[off[i] : off[j]].tobytes()
                yield pa.RecordBatch.from_arrays([rb.column(0).slice(i, j - i), pa.array([shingle_set(data[off[r] - off[i] : off[r + 1] - off[i]]).tobytes() for r in range(i, j)], pa.binary())], names=["node", "set"])

    return texts.mapInArrow(run, "node long, set binary")


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity at least."""
    side = lambda s: sets.select(F.col("node").alias(s), F.col("set").alias(f"s{s}"))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            ok = []
            for x, y in zip(rb.column("sa"), rb.column("sb"), strict=True):
                u, v = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = len(np.intersect1d(u, v, assume_unique=True))
                ok.append(both >= similarity * (len(u) + len(v) - both))
            yield rb.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def nearest(rows: DataFrame, *, k: int, reach: int, similarity: float) -> DataFrame:
    """Of each row of a slice (w, s) the k nearest nodes of other roots within reach: (w, s, hot, node, fp, size, other).  Rows of
    hot shards that find none stay, with a null."""
    ordered = rows.select("w", "s", "hot", "node", "fp", "size", "root").repartition("w", "s").sortWithinPartitions("w", "s", "node")

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, s, hot, node, fp, size, root in whole_runs(batches, 2):
            first = np.flatnonzero(_runs(w, s))
            n = np.diff(np.concatenate([first, [len(w)]]))
            many = np.flatnonzero(np.repeat(n > 1, n))
            alone = np.flatnonzero(hot & np.repeat(n == 1, n))
            qs, ts = [alone], [np.full(len(alone), -1)]
            if len(many):
                place = np.cumsum(np.repeat(n > 1, n)) - 1
                head, count = place[np.repeat(first, n)[many]], np.repeat(n, n)[many]
                nodes, sizes, roots = node[many], size[many], root[many]
                forest = BKForest(np.ascontiguousarray(fp[many]).view(np.uint64), head)
                i = 0
                while i < len(many):  # so many queries at a time that their pairs stay bounded
                    j = i + max(1, int(np.searchsorted(np.cumsum(count[i : i + (1 << 16)]), 1 << 20)))
                    found = [np.zeros((2, 0), np.int64)]
                    for q, t in forest.within(np.arange(i, min(j, len(many))), reach):
                        ok = (roots[q] != roots[t]) & (np.minimum(sizes[q], sizes[t]) >= similarity * np.maximum(sizes[q], sizes[t]))
                        found.append(np.stack([q[ok], t[ok]]))
                    q, t = np.concatenate(found, axis=1)
                    d = np.bitwise_count(forest.fps[q] ^ forest.fps[t])
                    order = np.lexsort((nodes[t], d, q))
                    q, t = q[order], t[order]
                    at = np.flatnonzero(_runs(q)) if len(q) else np.zeros(0, int)
                    rank = np.arange(len(q)) - np.repeat(at, np.diff(np.concatenate([at, [len(q)]])))
                    qs.append(many[q[rank < k]])
                    ts.append(many[t[rank < k]])
                    none = np.setdiff1d(np.arange(i, min(j, len(many))), q)
                    none = many[none[hot[many[none]]]]
                    qs.append(none)
                    ts.append(np.full(len(none), -1))
                    i = j
            q, t = np.concatenate(qs), np.concatenate(ts)
            other = pa.array(node[np.maximum(t, 0)], pa.int64(), mask=t < 0)
            yield pa.RecordBatch.from_arrays([*[pa.array(c[q]) for c in (w, s, hot, node, fp, size)], other], names=["w", "s", "hot", "node", "fp", "size", "other"])

    return ordered.mapInArrow(run, "w long, s int, hot boolean, node long, fp long, size int, other long")


def first_rows(docs: DataFrame, names: DataFrame, *, key: str, text: str) -> DataFrame:
    """(node, text) for names (node, __key, h)."""
    texts = docs.select(F.col(key).alias("__k"), F.xxhash64(text).alias("__x"), F.col(text).alias("__text"))
    return texts.join(broadcast_if(names), F.col("__k").eqNullSafe(F.col("__key")) & (F.col("__x") == F.col("h"))).select("node", "__text")


def linked(rows: DataFrame, docs: DataFrame, *, similarity: float, reach: int, limit: int, room: int, key: str, text: str) -> DataFrame:
    """(a, b): links that join the nodes of the sketched rows into their groups."""
    every = rows.dropDuplicates(["node"]).select(F.explode("words").alias("w"), "node", "fp", "size")
    need = F.greatest(F.ceil(F.count(F.lit(1)) / limit), F.ceil(F.sum(F.col("size").cast("long")) / room))
    large = checkpoint(every.groupBy("w").agg(need.alias("n")).where("n > 1"))
    if large.isEmpty():
        every = every.withColumns({"s": F.lit(0), "hot": F.lit(False)})
    else:
        every = every.join(large, "w", "left").withColumns({"s": F.coalesce(F.pmod(F.xxhash64("node"), F.col("n")).cast("int"), F.lit(0)), "hot": F.col("n").isNotNull()}).drop("n")
    near = checkpoint(nearest(every.withColumn("root", F.col("node")), k=1, reach=reach, similarity=similarity))
    pairs = checkpoint(near.where("other IS NOT NULL").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct())
    wanted = near.select("node").unionByName(near.where("other IS NOT NULL").select(F.col("other").alias("node"))).distinct()
    names = rows.groupBy("node").agg(F.min(F.struct("__key", "h")).alias("f")).join(wanted, "node", "left_semi")
    names = checkpoint(names.select("node", "f.__key", "f.h"))
    sets = checkpoint(shingle_sets(first_rows(docs, names, key=key, text=text).dropDuplicates(["node"])))
    links = checkpoint(similar(pairs, sets, similarity))
    rooted = near.drop("other").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = rooted.groupBy("w").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("s").alias("last")).where("lo <> hi").select("w", "last")
    mixed = checkpoint(rooted.join(several, "w"))  # shards that still hold several groups
    main = mixed.groupBy("w", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("w").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    asked = mixed.join(main, "w").withColumn("query", F.col("root") != F.col("main")).drop("main", "hot")
    guests = asked.where("query AND last > 0").withColumn("home", F.col("s")).withColumn("s", F.explode(F.sequence(F.lit(0), "last"))).where("s <> home").withColumn("guest", F.lit(True)).drop("home")
    rows_ = asked.withColumn("guest", F.lit(False)).unionByName(guests).join(sets, "node")
    return links.unionByName(searched(rows_, reach=reach, similarity=similarity))


def searched(rows: DataFrame, *, reach: int, similarity: float) -> DataFrame:
    """(a, b): links between the groups (root) of each slice (w, s), from its ``query`` rows to all but guests of other slices.  A
    slice's sets come to its task once, and only links that join two groups leave it."""
    ordered = rows.select("w", "s", "node", "fp", "size", "root", "query", "guest", "set").repartition("w", "s").sortWithinPartitions("w", "s", "node")

    def links(node: np.ndarray, fp: np.ndarray, size: np.ndarray, root: np.ndarray, query: np.ndarray, guest: np.ndarray, sets: np.ndarray) -> list[tuple[int, int]]:
        got: list[tuple[int, int]] = []
        bits, label = np.ascontiguousarray(fp).view(np.uint64), np.unique(root, return_inverse=True)[1]
        ids = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_inverse=True)[1]
        at = np.concatenate([[0], np.cumsum(size)])
        alone = np.add.reduceat(np.bincount(ids)[ids] == 1, at[:-1]) if len(ids) else np.zeros(len(node))
        mark = np.zeros(int(ids.max()) + 1 if len(ids) else 0, bool)
        for q in np.flatnonzero(query & (size - alone >= similarity * size)):  # a shingle of no other text lowers all similarities
            fits = (label != label[q]) & ~guest & (np.bitwise_count(bits ^ bits[q]) <= reach) & (np.minimum(size, size[q]) >= similarity * np.maximum(size, size[q]))
            c = np.flatnonzero(fits)
            if not len(c):
                continue
            mark[ids[at[q] : at[q + 1]]] = True
            for k in range(0, len(c), 1024):
                part = c[k : k + 1024]
                n = size[part].astype(np.int64)
                both = np.add.reduceat(mark[ids[np.repeat(at[part] - np.cumsum(n) + n, n) + np.arange(n.sum())]], np.cumsum(n) - n, dtype=np.int64)
                for x in part[both >= similarity * (n + size[q] - both)].tolist():
                    if label[x] != label[q]:
                        got.append((int(node[q]), int(node[x])))
                        label[label == label[x]] = label[q]
            mark[ids[at[q] : at[q + 1]]] = False
        return got

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in whole_runs(batches, 2):
            first = np.flatnonzero(_runs(*columns[:2])).tolist()
            for i, j in zip(first, [*first[1:], len(columns[0])], strict=True):
                if columns[6][i:j].any() and (got := links(*[c[i:j] for c in columns[2:]])):
                    a, b = zip(*got, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return ordered.mapInArrow(run, "a long, b long")


def deduplicate(docs: DataFrame, *, key: str = "doc_id", text: str = "text", similarity: float = 0.8, reach: int = 24, limit: int = 8192, room: int = 4_000_000) -> DataFrame:
    """One row of docs, the one with the smallest key, of each group of near copies.  A slice of a shard has ``limit`` texts and
    ``room`` shingles at most, but for a single longer text."""
    rows = checkpoint(sketches(docs, key=key, text=text))
    member = components(linked(rows, docs, similarity=similarity, reach=reach, limit=limit, room=room, key=key, text=text))
    row = F.struct(F.col("__key").isNull().alias("none"), F.col("__key").alias("key"), "h").alias("row")
    named = rows.select("node", row).groupBy("node", "row").agg(F.count(F.lit(1)).alias("n")).join(member, "node", "left").select("row", "n", F.coalesce("root", "node").alias("root"))
    named = checkpoint(named)
    low = named.groupBy("root").agg(F.min("row").alias("low"))
    marked = named.join(low, "root").select(F.col("row.key").alias("__k"), F.col("row.h").alias("__h"), (F.col("row") == F.col("low")).alias("first"), "n")
    gone = checkpoint(marked.where(~F.col("first")).select("__k", "__h"))
    twice = checkpoint(marked.where("first AND n > 1").select("__k", "__h"))
    same = lambda left, names: left[key].eqNullSafe(names["__k"]) & (F.xxhash64(left[text]) == names["__h"])
    gone = broadcast_if(gone)
    kept = docs.join(gone, same(docs, gone), "left_anti")
    if not twice.isEmpty():
        twice = broadcast_if(twice)
        kept = kept.join(twice, same(kept, twice), "left_anti").unionByName(kept.join(twice, same(kept, twice), "left_semi").dropDuplicates([key, text]))
    return kept
