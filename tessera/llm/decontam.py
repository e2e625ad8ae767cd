"""Benchmark decontamination: a prefix-filtered containment join of word shingles, in DataFrame operations only.

Words: A-Z lower-cased, then runs of digits, a-z and non-ASCII characters.  A window is ``window`` consecutive words of
an item; an item of fewer words, but not none, is one window.  A document word is hit if it lies in an occurrence of a
window.

Containment of a whole window requires all its shingles, so one is a sufficient prefix: the shingles of a window
(``shingle`` words, or the whole of a shorter window) are ordered by rarity among the benchmark's items and only the
rarest is joined, with its position in the window.  A match is bounded by length and position (the window must fit into the
document around the shingle) and verified word by word against the document.  Exploding positions, probing and
verifying form one pipelined stage, so only true occurrences are ever shuffled, however frequent a shingle is in the
corpus.  The prefix table is broadcast if it has ``broadcast_rows`` rows at most; a larger one is joined by a shuffle of
(document, position, shingle), and verified afterwards against the document's words.

Defined results: one row for each distinct (id, text) of docs; null and empty texts have no words and no hits.  Items
with equal ids are told apart by text and count once in n_items.  Items without words are ignored; an empty benchmark
contaminates nothing.  Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, checkpoint

#: What separates words after lower-casing.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Array of words; empty for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def shingle_hash(array: Column, at: Column, width: int) -> Column:
    return F.xxhash64(*[F.get(array, at + k) for k in range(width)])


def prefixes(items: DataFrame, *, item: str, text: str, window: int, shingle: int) -> DataFrame:
    """(h, width, lead, win, item): for each distinct window of an item its rarest shingle and the words before it."""
    whole = items.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - window, F.lit(0))
    wins = whole.select("item", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("w", i + 1, F.lit(window)))).alias("win")).distinct()
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.size("win") - shingle, F.lit(0)))).alias("lead")
    placed = wins.select("item", "win", at)
    width = F.least(F.size("win"), F.lit(shingle))
    hashed = F.when(width == shingle, shingle_hash(F.col("win"), F.col("lead"), shingle))
    for k in range(1, shingle):
        hashed = hashed.when(width == k, shingle_hash(F.col("win"), F.col("lead"), k))
    placed = placed.withColumn("width", width).withColumn("h", hashed)
    rarity = placed.groupBy("h").agg(F.count_distinct("item").alias("n"))
    order = Window.partitionBy("item", "win").orderBy("n", "h", "lead")
    return placed.join(rarity, "h").withColumn("r", F.row_number().over(order)).where("r = 1").select("h", "width", "lead", "win", "item")


def placed(base: DataFrame, widths: list[int]) -> DataFrame:
    """A row with i = -1 for each document, and one for each position and shingle width."""
    w = len(widths)
    j = F.col("j")
    spots = base.select("id", "row", "w", F.explode(F.sequence(F.lit(-1), F.size("w") * w - 1)).alias("j"))
    i = F.when(j < 0, F.lit(-1)).otherwise((j / F.lit(max(w, 1))).cast("int"))
    width, h = F.lit(None).cast("int"), F.lit(None).cast("bigint")
    if w:
        width, h = F.when(j >= 0, F.lit(widths[0])), F.lit(None).cast("bigint")
        for k, size in enumerate(widths):
            here = (j >= 0) & (j % w == k)
            width = F.when(here, size) if k == 0 else F.when(here, size).otherwise(width)
            fits = here & (i + size <= F.size("w"))
            h = F.when(fits, shingle_hash(F.col("w"), i, size)).otherwise(h)
    return spots.select("id", "row", "w", i.alias("i"), width.alias("width"), h.alias("h"))


def fits(i: str = "i") -> Column:
    """Length and position bounds, then the window's own words."""
    start = F.col(i) - F.col("lead")
    return (start >= 0) & (start + F.size("win") <= F.size("w")) & (F.slice("w", start + 1, F.size("win")) == F.col("win"))


def occurrences(docs: DataFrame, items: DataFrame, *, key: str, text: str, item: str, item_text: str, window: int, shingle: int, broadcast_rows: int) -> DataFrame:
    """(id, row, n_words, start, stop, item): a row with null start for each document, and one for each occurrence."""
    pre = checkpoint(prefixes(items, item=item, text=item_text, window=window, shingle=shingle))
    widths = sorted(r.width for r in pre.select("width").distinct().collect())
    base = docs.select(F.col(key).alias("id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("row"), words(F.col(text)).alias("w"))
    start = F.when(F.col("i") >= 0, F.col("i") - F.col("lead"))
    found = [F.col("id"), F.col("row"), F.when(F.col("i") < 0, F.size("w")).alias("n_words"), start.alias("start"), (start + F.size("win")).alias("stop"), F.col("item")]
    spots = placed(base, widths)
    if pre.count() <= broadcast_rows:
        return spots.join(F.broadcast(pre), ["h", "width"], "left").where((F.col("i") < 0) | (F.col("win").isNotNull() & fits())).select(found)
    # too many prefixes for a broadcast: candidates by a shuffle of positions, then the documents' words once more
    candidates = spots.where("i >= 0 and h is not null").select("id", "row", "i", "h", "width").join(pre, ["h", "width"]).select(F.col("id").alias("cid"), F.col("row").alias("crow"), "i", "lead", "win", "item").distinct()
    one = base.dropDuplicates(["id", "row"])
    hits = candidates.join(one, F.col("id").eqNullSafe(F.col("cid")) & (F.col("row") == F.col("crow"))).where(fits())
    alone = base.select("id", "row", F.size("w").alias("n_words"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("stop"), F.lit(None).cast("string").alias("item"))
    return alone.unionByName(hits.select(found))


def covered(spans: Column) -> Column:
    """Length of the union of (start, stop) spans sorted by start."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["start"], a["end"]))).alias("n"), F.greatest(a["end"], s["stop"]).alias("end"))
    return F.aggregate(spans, zero, step, lambda a: a["n"])


def report(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, shingle: int = 5, broadcast_rows: int = 500_000) -> DataFrame:
    """Per distinct (id, text): key, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = occurrences(docs, items, key=key, text=text, item=item, item_text=item_text, window=window, shingle=shingle, broadcast_rows=broadcast_rows)
    per = found.groupBy("id", "row").agg(
        F.max("n_words").alias("n_words"),
        F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "stop"))).alias("spans"),
        F.collect_set("item").alias("items"),
    )
    n_hit = covered(F.array_sort("spans"))
    return per.select(
        F.col("id").alias(key),
        F.col("n_words").cast("bigint").alias("n_words"),
        n_hit.cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", **how: object) -> DataFrame:
    """The rows of docs that hold no window of an item."""
    how = {"item": "item_id", "item_text": "text", "window": 10, "shingle": 5, "broadcast_rows": 500_000} | how
    hit = checkpoint(occurrences(docs, items, key=key, text=text, **how).where("start is not null").select(F.col("id").alias("__id"), F.col("row").alias("__row")).distinct())
    hit = F.broadcast(hit) if hit.count() <= how["broadcast_rows"] else hit
    row = F.coalesce(F.xxhash64(docs[text]), F.lit(0))
    return docs.join(hit, docs[key].eqNullSafe(hit["__id"]) & (row == hit["__row"]), "left_anti")
