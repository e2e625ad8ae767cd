"""Sequence packing by Karmarkar-Karp multiway differencing.

Every document's token ids (and one end id) are cut into full windows and a tail; tails are cut into pieces of at most
``piece`` ids.  Pieces are gathered in blocks of about ``windows`` windows.  Differencing starts from partial
partitions of one piece each and keeps merging the two whose window sums differ most, the larger sums of one with the
smaller sums of the other, until one near-equal partition is left.  If its largest window exceeds the capacity, the
block is partitioned again with one window more.  Blocks never cross tasks and are made in the order in which the rows
are stored, so a task that is run again gives the same rows, and memory is bounded by a block and a document.

Token ids come from a ``tokenizers`` file whose pre-tokens never cross white space: ids of white-space-separated words are kept
in a table of each Python worker, bounded in bytes.  Texts with characters for which this is not known to equal the whole-text
result (combining marks, other scripts, control characters, the special tokens' strings) are handed to the library whole.

Defined results: null and empty texts have the end id alone.  Rows are packed one by one: repeated rows and null keys
are packed as often as they come.  Other columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, count, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, groups_by_bytes, texts

#: Characters whose normal form, lower case and word limits are the same everywhere.
_PLAIN = re.compile("[\t\n\x0b\x0c\r\x20-\x7e\xa1-\xac\xae-įı-ɏ‐-―‘-‧‰-⁞€]*")

class WordIds:
    """Ids of whole texts through a bounded table of words.

    Words of letters are learned many at a time: joined by spaces each is one pre-token, which ends in the only id
    that carries the end-of-word mark.  Such a word with one mark behind it is the word's ids and the mark's.
    """

    MARKS = ".,;:!?"

    def __init__(self, path: str, most: int = 64 << 20) -> None:
        """most: bytes of the table, by about 120 for each word beside its text and ids."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker is one of many; threads would each hold memory
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.most = most
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        marks = {c: self._encode([c])[0] for c in self.MARKS}
        self.mark = {c: ids[0] for c, ids in marks.items() if len(ids) == 1}
        self._clear()

    def _encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.n_words, self.n_ids, self.size = 0, 0, 0
        self.starts, self.flat = np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32)

    def _add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, m = self.n_words + len(words), self.n_ids + len(ids)
        if n + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(n + 1, np.int64)])
        if m > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(m, np.uint32)])
        self.starts[self.n_words + 1 : n + 1] = self.n_ids + np.cumsum(sizes)
        self.flat[self.n_ids : m] = ids
        self.at.update(zip(words, range(self.n_words, n), strict=True))
        self.size += 4 * len(ids) + 120 * len(words) + sum(map(len, words))
        self.n_words, self.n_ids = n, m

    def _gather(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo, n = self.starts[k], self.starts[k + 1] - self.starts[k]
        return self.flat[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())], n

    def _learn(self, words: list[str]) -> None:
        stems, marked, rest = {}, [], []
        for w in words:
            if w.isalpha():
                stems[w] = None
            elif w[-1] in self.mark and w[:-1].isalpha():
                marked.append(w)
                if w[:-1] not in self.at:
                    stems[w[:-1]] = None
            else:
                rest.append(w)
        letters = list(stems)
        if letters:
            got = self._encode([" ".join(letters[i : i + 16]) for i in range(0, len(letters), 16)])
            ids = np.fromiter((x for g in got for x in g), np.uint32)
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(letters) and last[-1] == len(ids) - 1:
                self._add(letters, ids, np.diff(last, prepend=-1))
            else:
                rest += letters
        if rest:
            got = self._encode(rest)
            self._add(rest, np.fromiter((x for g in got for x in g), np.uint32), np.array([len(g) for g in got]))
        if marked:
            ids, n = self._gather(np.array([self.at[w[:-1]] for w in marked]))
            ends = np.cumsum(n)
            self._add(marked, np.insert(ids, ends, [self.mark[w[-1]] for w in marked]), n + 1)

    def __call__(self, items: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(items)
        plain = []
        for i, t in enumerate(items):
            if _PLAIN.fullmatch(t) and not any(s in t for s in self.special):
                plain.append(i)
            else:
                out[i] = np.array(self.tok.encode(t, add_special_tokens=False).ids, np.uint32)
        split = [items[i].lower().split() for i in plain]
        words = list(chain.from_iterable(split))
        k = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        if (k < 0).any():
            unknown = np.flatnonzero(k < 0)
            if self.size > self.most:
                self._clear()
                unknown = np.arange(len(words))
            self._learn(list({words[i] for i in unknown.tolist()}))
            k[unknown] = [self.at[words[i]] for i in unknown.tolist()]
        ids, n = self._gather(k)
        cuts = np.concatenate([[0], np.cumsum(n)])[np.cumsum([0, *map(len, split)])]
        for j, i in enumerate(plain):
            out[i] = ids[cuts[j] : cuts[j + 1]]
        return out  # type: ignore[return-value]


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One per worker and file."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: indexes of ``sizes`` in each of k parts with near-equal sums."""
    order = count()
    # a partial partition: its part sums in descending order, and the parts; parts that are still empty are left out
    heap = [(-s, next(order), [s], [[i]]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a, pa_ = heapq.heappop(heap)
        _, _, b, pb = heapq.heappop(heap)
        over = len(a) + len(b) - k  # parts that meet: the smallest of a with the largest of b, and so on
        if over > 0:
            sums = a[: len(a) - over] + [x + y for x, y in zip(a[len(a) - over :], reversed(b[len(b) - over :]), strict=True)] + b[: len(b) - over]
            parts = pa_[: len(a) - over] + [x + y for x, y in zip(pa_[len(a) - over :], reversed(pb[len(b) - over :]), strict=True)] + pb[: len(b) - over]
        else:
            sums, parts = a + b, pa_ + pb
        by = sorted(range(len(sums)), key=sums.__getitem__, reverse=True)
        sums, parts = [sums[i] for i in by], [parts[i] for i in by]
        low = sums[-1] if len(sums) == k else 0
        heapq.heappush(heap, (low - sums[0], next(order), sums, parts))
    return heap[0][3] if heap else []


def partition(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows; one more whenever one exceeds the capacity."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = difference(sizes, k)
        if all(sum(sizes[i] for i in p) <= capacity for p in parts):
            return parts
        k += 1


class Packer:
    """Takes documents one after the other; gives rows (row, start, length, crc, doc_tokens, sequence, offset)."""

    def __init__(self, capacity: int, piece: int, windows: int, slack: int) -> None:
        self.capacity, self.piece, self.target = capacity, piece, windows * (capacity - slack)
        self.wait: list[tuple] = []  # key, start, ids, doc_tokens
        self.total, self.next = 0, 0

    def _close(self) -> Iterator[tuple]:
        for part in partition([len(w[2]) for w in self.wait], self.capacity):
            offset = 0
            for i in part:
                key, start, ids, n = self.wait[i]
                yield key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, self.next, offset
                offset += len(ids)
            self.next += 1
        self.wait, self.total = [], 0

    def add(self, key: object, ids: np.ndarray) -> Iterator[tuple]:
        n, at = len(ids), 0
        while n - at >= self.capacity:
            part = ids[at : at + self.capacity]
            yield key, at, len(part), zlib.crc32(part.astype("<u4").tobytes()), n, self.next, 0
            self.next += 1
            at += self.capacity
        pieces = -(-(n - at) // self.piece)
        for _ in range(pieces):
            end = min(n, at + self.piece)  # the last piece is a small one: such pieces even out the windows
            while at < end:
                take = min(end - at, self.target - self.total)
                self.wait.append((key, at, ids[at : at + take], n))
                self.total += take
                at += take
                if self.total == self.target:
                    yield from self._close()

    def finish(self) -> Iterator[tuple]:
        if self.wait:
            yield from self._close()


def pack(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", end_id: int = 1, capacity: int = 2048, piece: int = 256, windows: int = 96, slack: int = 1) -> DataFrame:
    """One row per piece.  ``tokenizer``: path of a ``tokenizers`` file that every executor can read."""
    plain = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    names = ["__key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, packer = word_ids(tokenizer), Packer(capacity, piece, windows, slack)
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 36  # sequences are numbered within a task
        key_type = None

        def rows(got: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*got, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], key_type), *[pa.array(c, pa.int64()) for c in cols[1:5]], pa.array([base + c for c in cols[5]], pa.int64()), pa.array(cols[6], pa.int64())], names=names)

        end = np.array([end_id], np.uint32)
        for rb in batches:
            key_type = rb.column(0).type
            keys = rb.column(0).to_pylist()
            sizes = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(rb.column(1)), 0).to_numpy(zero_copy_only=False))])
            for a, b in groups_by_bytes(sizes, 1 << 20):
                for i in range(a, b, 256):
                    out: list[tuple] = []
                    n = min(256, b - i)
                    for k, ids in zip(keys[i : i + n], ids_of(texts(rb.column(1).slice(i, n))), strict=True):
                        out += packer.add(k, np.concatenate([ids, end]))
                    if out:
                        yield rows(out)
        if out := list(packer.finish()):
            yield rows(out)

    schema = f"__key {plain.schema[0].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names[1:])
    return plain.mapInArrow(run, schema).withColumnRenamed("__key", key)
