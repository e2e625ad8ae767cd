"""Entity resolution: token blocking, block purging and filtering, meta-blocking, matching, clustering.

All steps are equi-joins and aggregations.  Blocks that purging keeps are bounded by its cut, pairs are counted per
block with the smaller id first, and components come from rounds that are cut by checkpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..exceptions import IllegalParameterError
from ..functions.similarity import SPLIT, similarity
from .graph import checkpoint, components


def profiles(df: DataFrame, columns: tuple[str, ...], index_col: str) -> DataFrame:
    """(pid, attr, value): non-null cells, arrays exploded.  pid is the index."""
    parts = []
    for c in columns:
        kind = df.schema[c].dataType
        values = F.explode(F.col(c).cast("array<string>")) if isinstance(kind, T.ArrayType) else F.col(c).cast("string")
        parts.append(df.select(F.col(index_col).alias("pid"), F.lit(c).alias("attr"), values.alias("value")).where("value is not null"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def attribute_clusters(df: DataFrame, columns: tuple[str, ...], index_col: str = "id", target_threshold: float = 0.3) -> DataFrame:
    """(attr, cluster, entropy): attributes whose token sets have a Jaccard similarity of at least the threshold share a cluster;
    entropy is that of the cluster's tokens.  Similarities come from one join of distinct (attribute, token) pairs."""
    tokens = F.explode(F.array_remove(F.split(F.lower("value"), SPLIT), ""))
    cells = checkpoint(profiles(df, columns, index_col).select("attr", tokens.alias("t")).groupBy("attr", "t").agg(F.count(F.lit(1)).alias("n")))
    sets = cells.select("attr", "t")
    size = {r.attr: r.n for r in sets.groupBy("attr").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per column
    both = sets.withColumnRenamed("attr", "a").join(sets.withColumnRenamed("attr", "b"), "t").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).collect()
    of = {c: k for k, c in enumerate(columns)}
    for r in both:
        if r.n / (size[r.a] + size[r.b] - r.n) >= target_threshold:
            low, high = sorted((of[r.a], of[r.b]))
            of = {c: low if k == high else k for c, k in of.items()}
    cluster = F.create_map(*[F.lit(x) for c, k in of.items() for x in (c, k)])
    mass = cells.withColumn("cluster", cluster[F.col("attr")]).groupBy("cluster", "t").agg(F.sum("n").alias("n"))
    total = mass.groupBy("cluster").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"))
    entropy = total.select("cluster", (F.log("m") - F.col("s") / F.col("m")).alias("entropy"))
    names = F.explode(F.array(*[F.struct(F.lit(c).alias("attr"), F.lit(k).alias("cluster")) for c, k in of.items()]))
    return df.sparkSession.range(1).select(names.alias("x")).select("x.*").join(entropy, "cluster", "left").select("attr", "cluster", F.coalesce("entropy", F.lit(0.0)).alias("entropy"))


def token_blocks(df: DataFrame, columns: tuple[str, ...], index_col: str = "id", *, clusters: dict[str, int] | None = None) -> DataFrame:
    """(block, pid): tokens that at least two profiles share; with ``clusters``, inside attributes of one cluster only."""
    tokens = F.explode(F.array_distinct(F.split(F.lower("value"), SPLIT)))
    cells = profiles(df, columns, index_col).select("pid", "attr", tokens.alias("block")).where("block <> ''")
    if clusters:
        cells = cells.withColumn("block", F.concat_ws("_", F.create_map(*[F.lit(x) for c, k in clusters.items() for x in (c, k)])[F.col("attr")].cast("string"), "block"))
    pairs = cells.select("pid", "block").distinct()
    shared = pairs.groupBy("block").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return pairs.join(shared, "block")


def purge(blocks: DataFrame, smooth: float = 1.015) -> DataFrame:
    """Drops blocks beyond the size at which comparisons stop being worth their share of entries."""
    levels = blocks.select("block", "size").distinct().groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy("size").collect()  # a row per block size
    total_c = total_b = 0
    steps = []
    for r in levels:
        total_c += r.n * r.size * (r.size - 1)
        total_b += r.n * r.size
        steps.append((r.size, total_c, total_b))
    cut = steps[-1][0] if steps else 0
    for (size, cc, bc), (_, below_cc, below_bc) in zip(steps[:0:-1], steps[-2::-1], strict=True):
        cut = size
        if below_bc * cc < smooth * below_cc * bc:  # without this level, comparisons an entry hardly fall
            break
    return blocks.where(F.col("size") <= cut)


def filter_blocks(blocks: DataFrame, keep: float = 0.8) -> DataFrame:
    """Each profile keeps the smallest round(keep * n) of its n blocks, one at least, and ties of the last."""
    w = Window.partitionBy("pid")
    n = F.greatest(F.lit(1), F.round(F.count(F.lit(1)).over(w) * keep).cast("int"))
    ranked = blocks.withColumn("__k", n).withColumn("__r", F.rank().over(w.orderBy("size"))).where("__r <= __k").drop("__k", "__r")
    sizes = ranked.groupBy("block").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return ranked.drop("size").join(sizes, "block")


def weighted_edges(blocks: DataFrame, weight: str = "cbs") -> DataFrame:
    """(i, j, w), i < j: common blocks, or the chi-square of the 2 x 2 table of block membership."""
    a, b = blocks.select("block", F.col("pid").alias("i")), blocks.select("block", F.col("pid").alias("j"))
    edges = a.join(b, "block").where("i < j").groupBy("i", "j").agg(F.count(F.lit(1)).cast("double").alias("w"))
    if weight == "cbs":
        return edges
    if weight != "chi_square":
        raise IllegalParameterError(f"unknown weight {weight!r}")
    total = blocks.select("block").distinct().count()
    per = blocks.groupBy("pid").agg(F.count(F.lit(1)).cast("double").alias("m"))
    e = edges.join(per.select(F.col("pid").alias("i"), F.col("m").alias("mi")), "i").join(per.select(F.col("pid").alias("j"), F.col("m").alias("mj")), "j")
    n, o = F.lit(float(total)), F.col("w")
    out = F.lit(0.0)
    for x, ex in ((o, F.col("mi") * F.col("mj") / n), (F.col("mi") - o, F.col("mi") * (n - F.col("mj")) / n), (F.col("mj") - o, (n - F.col("mi")) * F.col("mj") / n), (n - F.col("mi") - F.col("mj") + o, (n - F.col("mi")) * (n - F.col("mj")) / n)):
        out = out + F.when(ex > 0, (x - ex) * (x - ex) / ex).otherwise(0.0)
    return e.select("i", "j", out.alias("w"))


def prune(edges: DataFrame, *, comparison: str = "or", threshold: str = "avg", weight: str = "cbs") -> DataFrame:
    """Weighted node pruning: a node's threshold is the average (or half the maximum) of its edges, itself included; an edge
    stays if it reaches the threshold of either end (or), or of both (and); chi-square weights are held against
    sqrt(t_i^2 + t_j^2) / 2."""
    if comparison not in ("or", "and") or threshold not in ("avg", "max_div_2"):
        raise IllegalParameterError("comparison is 'or' or 'and', threshold 'avg' or 'max_div_2'")
    ends = edges.select(F.col("i").alias("p"), "w").unionByName(edges.select(F.col("j").alias("p"), "w"))
    t = ends.groupBy("p").agg((F.sum("w") / (F.count(F.lit(1)) + 1) if threshold == "avg" else F.max("w") / 2).alias("t"))
    e = edges.join(t.select(F.col("p").alias("i"), F.col("t").alias("ti")), "i").join(t.select(F.col("p").alias("j"), F.col("t").alias("tj")), "j")
    if weight == "chi_square":
        return e.where(F.col("w") >= F.sqrt(F.col("ti") ** 2 + F.col("tj") ** 2) / 2).select("i", "j", "w")
    low, high = F.col("w") >= F.col("ti"), F.col("w") >= F.col("tj")
    return e.where((low | high) if comparison == "or" else (low & high)).select("i", "j", "w")


def match(df: DataFrame, edges: DataFrame, columns: tuple[str, ...], index_col: str, *, kind: str = "cosine", least: float = 0.5) -> DataFrame:
    """Edges whose mean similarity over the columns is at least ``least``; a column missing on either side adds 0."""
    flat = lambda c: F.concat_ws(" ", F.col(c).cast("array<string>")) if isinstance(df.schema[c].dataType, T.ArrayType) else F.col(c).cast("string")
    side = lambda s: df.select(F.col(index_col).alias(s), *[flat(c).alias(f"{s}_{k}") for k, c in enumerate(columns)])
    both = edges.join(side("i"), "i").join(side("j"), "j")
    total = F.lit(0.0)
    for k in range(len(columns)):
        total = total + similarity(kind, F.col(f"i_{k}"), F.col(f"j_{k}"))
    return both.withColumn("similarity", total / len(columns)).where(F.col("similarity") >= least).select("i", "j", "similarity")


def candidate_edges(df: DataFrame, columns: tuple[str, ...], *, index_col: str = "id", smooth: float = 1.015, keep: float = 0.8, weight: str = "cbs", comparison: str = "or", threshold: str = "avg", cluster_attributes: bool = False, target_threshold: float = 0.3) -> DataFrame:
    clusters = {r.attr: r.cluster for r in attribute_clusters(df, columns, index_col, target_threshold).collect()} if cluster_attributes else None
    blocks = checkpoint(filter_blocks(purge(token_blocks(df, columns, index_col, clusters=clusters), smooth), keep))
    return prune(weighted_edges(blocks, weight), comparison=comparison, threshold=threshold, weight=weight)


def resolve(df: DataFrame, columns: tuple[str, ...] | list[str] | str, *, index_col: str = "id", similarity_type: str = "cosine", similarity_threshold: float = 0.5, **how: object) -> DataFrame:
    """(index, columns, cluster) of the rows that share an entity with another; cluster is its smallest index."""
    columns = (columns,) if isinstance(columns, str) else tuple(columns)
    edges = match(df, candidate_edges(df, columns, index_col=index_col, **how), columns, index_col, kind=similarity_type, least=similarity_threshold)
    member = components(edges.select(F.col("i").alias("a"), F.col("j").alias("b")))
    all_ = checkpoint(member.unionByName(member.select(F.col("root").alias("node"), "root")).distinct())
    return df.join(all_, df[index_col] == all_["node"]).select(df[index_col], *[df[c] for c in columns if c != index_col], F.col("root").alias("cluster"))
