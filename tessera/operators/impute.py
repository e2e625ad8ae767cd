"""Imputation by naive Bayes from other columns."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..exceptions import TransformError


def naive_bayes(df: DataFrame, target: str, dependents: tuple[str, ...], *, allowed_values: tuple[Any, ...] = (), index_col: str = "id", max_candidates: int = 10_000) -> DataFrame:
    """Null targets become the candidate with most observed attributes, then the highest N_v * prod P(attr = a | v), then the
    smallest value; N_v counts rows with target v, and a zero probability becomes 1 / N_v.  Attributes that are null, in the
    row or never seen with a non-null target, are skipped; a row without usable attributes stays null.

    Only distinct attribute combinations of null rows meet the candidates, whose number is checked against
    ``max_candidates`` before they are broadcast; so the work is bounded by distinct combinations, not rows.
    """
    full = df.where(F.col(target).isNotNull())
    kind = df.schema[target].dataType
    value = F.col(target).cast("string")
    prior = full.groupBy(value.alias("v")).agg(F.count(F.lit(1)).alias("nv"))
    if allowed_values:
        prior = prior.where(F.col("v").isin([str(x) for x in allowed_values]))
    if prior.limit(max_candidates + 1).count() > max_candidates:
        raise TransformError(f"more than {max_candidates} candidate values of {target}; give allowed_values")
    attrs = lambda frame: frame.select("*", F.explode(F.array(*[F.struct(F.lit(i).alias("a"), F.col(c).cast("string").alias("x")) for i, c in enumerate(dependents)])).alias("__ax")).select("*", "__ax.a", "__ax.x").where("x is not null")
    seen = attrs(full.select(value.alias("v"), *dependents)).groupBy("a", "x", "v").agg(F.count(F.lit(1)).alias("n"))
    holes = df.where(F.col(target).isNull()).select(*dependents).distinct().withColumn("h", F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in dependents]))
    cells = attrs(holes).select("h", "a", "x")
    known = seen.groupBy("a", "x").agg(F.sum("n").alias("any"))
    usable = cells.join(known, ["a", "x"]).select("h", "a", "x")
    pairs = usable.join(F.broadcast(prior), F.lit(True)).join(seen, ["a", "x", "v"], "left")
    p = F.when(F.coalesce("n", F.lit(0)) > 0, F.col("n") / F.col("nv")).otherwise(1.0 / F.col("nv"))
    scored = pairs.groupBy("h", "v").agg((F.log(F.first("nv")) + F.sum(F.log(p))).alias("score"), F.count("n").alias("observed"))
    best = scored.groupBy("h").agg(F.min_by("v", F.struct((-F.col("observed")).alias("o"), (-F.round("score", 9)).alias("s"), F.col("v").alias("t"))).alias("__best"))
    mark = F.when(F.col(target).isNull(), F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in dependents]))
    out = df.withColumn("__h", mark).join(best.withColumnRenamed("h", "__h"), "__h", "left")
    return out.withColumn(target, F.coalesce(F.col(target), F.col("__best").try_cast(kind))).select(df.columns)
