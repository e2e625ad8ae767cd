"""Outlier models.  Every solver gives ``ratio``, ``detect``, ``predict``, ``remove`` and ``replace``.

Univariate models find bounds with one or two aggregates and end as a predicate.  Multivariate models add a score or
cluster and flag rows by a threshold; rows with a null in the columns are never flagged, and are dropped by ``remove``
like every row that is not an inlier.
"""

from __future__ import annotations

import enum
import json
import math
from collections.abc import Iterator
from copy import copy
from dataclasses import asdict, dataclass, fields
from typing import Any, ClassVar

import numpy as np
import pandas as pd
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA, Normalizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..exceptions import IllegalParameterError
from .graph import checkpoint, components
from .ordered import moving_average

FLAG = "__outlier"


class OutlierSolver(enum.Enum):
    KSIGMA = "k_sigma"
    TUKEY = "tukey"
    MAD = "mad"
    SMA = "sma"
    KMEANS = "kmeans"
    GMM = "gmm"
    DBSCAN = "dbscan"
    LOF = "lof"
    IFOREST = "iforest"
    PCA = "pca"
    AUTOENCODER = "autoencoder"


@dataclass(frozen=True)
class Params:
    model: ClassVar[str] = ""

    def to_json(self) -> str:
        return json.dumps({"model": self.model} | asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Params:
        given = json.loads(text)
        kind = PARAMS[given.pop("model")]
        return kind(**{k: v for k, v in given.items() if k in {f.name for f in fields(kind)}})


@dataclass(frozen=True)
class KSigmaParams(Params):
    model: ClassVar[str] = "k_sigma"
    deviation: float = 1.5


@dataclass(frozen=True)
class TukeyTestParams(Params):
    model: ClassVar[str] = "tukey"
    deviation: float = 1.5
    relative_error: float = 0.001


@dataclass(frozen=True)
class MADParams(Params):
    model: ClassVar[str] = "mad"
    deviation: float = 1.5
    relative_error: float = 0.001


@dataclass(frozen=True)
class SMAParams(Params):
    model: ClassVar[str] = "sma"
    deviation: float = 1.5
    radius: int = 5


@dataclass(frozen=True)
class KMeansParams(Params):
    model: ClassVar[str] = "kmeans"
    k: int = 2
    max_iter: int = 20
    seed: int | None = 1
    min_cluster: float = 1
    deviation: float = 1.5
    normalize: bool = False


@dataclass(frozen=True)
class GMMParams(Params):
    model: ClassVar[str] = "gmm"
    k: int = 2
    max_iter: int = 100
    tol: float = 0.01
    seed: int | None = 1
    min_cluster: float = 1
    deviation: float = 1.5


@dataclass(frozen=True)
class DBSCANParams(Params):
    model: ClassVar[str] = "dbscan"
    eps: float = 0.5
    min_pts: int = 5


@dataclass(frozen=True)
class LOFParams(Params):
    model: ClassVar[str] = "lof"
    min_pts: int = 5
    contamination: float = 0.05
    relative_error: float = 0.001
    block: int = 1024


@dataclass(frozen=True)
class IForestParams(Params):
    model: ClassVar[str] = "iforest"
    num_trees: int = 100
    max_samples: float = 1.0
    max_features: float = 1.0
    max_depth: int = 10
    bootstrap: bool = False
    seed: int = 24
    contamination: float = 0.05
    relative_error: float = 0.001


@dataclass(frozen=True)
class PCAParams(Params):
    model: ClassVar[str] = "pca"
    k: int = 3
    method: str = "quantile"
    contamination: float = 0.05
    relative_error: float = 0.001
    deviation: float = 1.5


@dataclass(frozen=True)
class AutoEncoderParams(Params):
    model: ClassVar[str] = "autoencoder"
    hidden_size: int = 3
    batch_size: int = 24
    num_epochs: int = 100
    method: str = "quantile"
    contamination: float = 0.05
    relative_error: float = 0.001
    deviation: float = 1.5
    seed: int = 1


PARAMS: dict[str, type[Params]] = {c.model: c for c in Params.__subclasses__()}


def accuracy(error: float) -> int:
    return min(2_000_000_000, math.ceil(1 / error)) if error > 0 else 2_000_000_000


class Solver:
    def __init__(self, columns: tuple[str, ...], params: Any, index_col: str) -> None:
        self.columns, self.p, self.index_col = columns, params, index_col

    learned: Any = None

    def learn(self, df: DataFrame) -> Any:
        """What ``judge`` needs to know of the rows it was trained on."""
        raise IllegalParameterError(f"{self.p.model} judges only the rows it is given")

    def judge(self, df: DataFrame, learned: Any) -> DataFrame:
        raise NotImplementedError

    def fit(self, df: DataFrame) -> Solver:
        """A solver that judges any rows by what it learned from these."""
        out = copy(self)
        out.learned = self.learn(df)
        return out

    def predict(self, df: DataFrame) -> DataFrame:
        """df with FLAG: true, false, or null where the row cannot be judged."""
        return self.judge(df, self.learn(df) if self.learned is None else self.learned)

    def judged(self) -> Column:
        """What the ratio divides by."""
        return F.count(F.lit(1))

    def ratio(self, df: DataFrame) -> float:
        r = self.predict(df).agg(F.count_if(FLAG).alias("out"), self.judged().alias("n")).first()
        return r.out / r.n if r.n else 0.0

    def detect(self, df: DataFrame) -> int:
        return self.predict(df).where(FLAG).count()

    def remove(self, df: DataFrame) -> DataFrame:
        return self.predict(df).where(~F.col(FLAG)).select(df.columns)

    def replace(self, df: DataFrame, values: tuple[Any, ...]) -> DataFrame:
        if len(values) != len(self.columns):
            raise IllegalParameterError("as many values as columns are needed")
        new = {c: F.when(F.col(FLAG), F.lit(v).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in zip(self.columns, values, strict=True)}
        return self.predict(df).withColumns(new).select(df.columns)


# --- univariate ---------------------------------------------------------------------------------------------------


class _Bounds(Solver):
    def bounds(self, df: DataFrame) -> tuple[float | None, float | None]:
        raise NotImplementedError

    @property
    def x(self) -> Column:
        return F.col(self.columns[0]).cast("double")

    def learn(self, df):
        if len(self.columns) != 1:
            raise IllegalParameterError(f"{self.p.model} takes one column")
        return self.bounds(df)

    def judge(self, df, learned):
        low, high = learned
        flag = F.lit(None).cast("boolean") if low is None else (self.x < low) | (self.x > high)
        return df.withColumn(FLAG, flag)


class KSigma(_Bounds):
    def judged(self):
        return F.count(self.x)

    def bounds(self, df):
        r = df.agg(F.avg(self.x).alias("m"), F.stddev_pop(self.x).alias("s")).first()
        return (None, None) if r.m is None else (r.m - self.p.deviation * r.s, r.m + self.p.deviation * r.s)


class Tukey(_Bounds):
    def bounds(self, df):
        q = df.agg(F.percentile_approx(self.x, [0.25, 0.75], accuracy(self.p.relative_error)).alias("q")).first().q
        if q is None:
            return None, None
        return q[0] - self.p.deviation * (q[1] - q[0]), q[1] + self.p.deviation * (q[1] - q[0])


class MAD(_Bounds):
    def bounds(self, df):
        median = lambda c: df.agg(F.percentile_approx(c, 0.5, accuracy(self.p.relative_error)).alias("q")).first().q
        m = median(self.x)
        if m is None:
            return None, None
        d = self.p.deviation * median(F.abs(self.x - m))
        return m - d, m + d


class SMA(_Bounds):
    def judged(self):
        return F.count(self.x)

    def predict(self, df):
        sd = df.agg(F.stddev_pop(self.x).alias("s")).first().s
        out = moving_average(df, self.columns[0], self.index_col, self.p.radius, "__ma")
        return out.withColumn(FLAG, F.abs(F.col("__ma") - self.x) > F.lit(self.p.deviation * sd if sd is not None else None)).drop("__ma")


# --- multivariate -------------------------------------------------------------------------------------------------


class _Vector(Solver):
    def features(self, df: DataFrame, name: str = "__features") -> DataFrame:
        """Rows with all columns filled, and their vector; the others come back in ``completed``."""
        cast = df.withColumns({f"__f{i}": F.col(c).cast("double") for i, c in enumerate(self.columns)}).dropna(subset=[f"__f{i}" for i in range(len(self.columns))])
        return VectorAssembler(inputCols=[f"__f{i}" for i in range(len(self.columns))], outputCol=name).transform(cast).drop(*[f"__f{i}" for i in range(len(self.columns))])

    def completed(self, df: DataFrame, flagged: DataFrame) -> DataFrame:
        some_null = F.lit(False)
        for c in self.columns:
            some_null = some_null | F.col(c).isNull()
        return flagged.select(*df.columns, FLAG).unionByName(df.where(some_null).withColumn(FLAG, F.lit(None).cast("boolean")))

    def threshold(self, scored: DataFrame, score: str, *, method: str = "quantile") -> float | None:
        if method == "quantile":
            return scored.agg(F.percentile_approx(score, 1 - self.p.contamination, accuracy(self.p.relative_error)).alias("t")).first().t
        if method != "stddev":
            raise IllegalParameterError(f"unknown method {method!r}")
        r = scored.agg(F.avg(score).alias("m"), F.stddev_pop(score).alias("s")).first()
        return None if r.m is None else r.m + self.p.deviation * r.s


class _Scored(_Vector):
    """Models that score rows and flag those above a threshold over the rows they were trained on."""

    def model(self, df: DataFrame) -> Any:
        raise NotImplementedError

    def scored(self, df: DataFrame, model: Any) -> DataFrame:
        """df with __score, null where a row cannot be scored."""
        raise NotImplementedError

    def learn(self, df):
        model = self.model(df)
        return model, None if model is None else self.threshold(self.scored(df, model), "__score", method=getattr(self.p, "method", "quantile"))

    def judge(self, df, learned):
        model, limit = learned
        if model is None:
            return df.withColumn(FLAG, F.lit(None).cast("boolean"))
        return self.scored(df, model).withColumn(FLAG, F.col("__score") > F.lit(limit)).select(*df.columns, FLAG)

    def predict(self, df):
        if self.learned is not None or (model := self.model(df)) is None:
            return super().predict(df) if self.learned is not None else self.judge(df, (None, None))
        rows = checkpoint(self.scored(df, model))  # scored once, for the threshold and the flags
        limit = self.threshold(rows, "__score", method=getattr(self.p, "method", "quantile"))
        return rows.withColumn(FLAG, F.col("__score") > F.lit(limit)).select(*df.columns, FLAG)


class _Clusters(_Vector):
    def model(self, rows: DataFrame) -> tuple[Any, np.ndarray, np.ndarray | None]:
        """The fitted model, and the centres and inverse covariances of its clusters."""
        raise NotImplementedError

    def prepared(self, df: DataFrame) -> DataFrame:
        return self.features(df)

    def placed(self, rows: DataFrame, model: tuple[Any, np.ndarray, np.ndarray | None]) -> DataFrame:
        """Rows with __cluster and __distance."""
        found, centres, inverse = model
        distance = _quadratic(vector_to_array(found.getFeaturesCol()), _constant(centres), None if inverse is None else _constant(inverse), F.col("__cluster"))
        return found.transform(rows).withColumn("__distance", distance)

    def learn(self, df):
        rows = self.prepared(df)
        model = self.model(rows)
        per = self.placed(rows, model).groupBy("__cluster").agg(F.count(F.lit(1)).alias("size"), (F.avg("__distance") + self.p.deviation * F.stddev_pop("__distance")).alias("most")).collect()  # k rows
        least = self.p.min_cluster * sum(r["size"] for r in per) if 0 <= self.p.min_cluster < 1 else self.p.min_cluster
        most = np.full(len(model[1]), -1.0)  # every row of a small cluster is beyond it
        for r in per:
            if r["size"] >= least:
                most[r["__cluster"]] = r["most"]
        return model, most

    def judge(self, df, learned):
        model, most = learned
        flagged = self.placed(self.prepared(df), model).withColumn(FLAG, F.col("__distance") > F.get(_constant(most), F.col("__cluster")))
        return self.completed(df, flagged)


def _constant(values: np.ndarray) -> Column:
    """A literal array (of arrays)."""
    return F.from_json(F.lit(json.dumps(np.asarray(values, float).tolist())), "array<" * values.ndim + "double" + ">" * values.ndim)


def _quadratic(x: Column, centres: Column, inverse: Column | None, k: Column) -> Column:
    d = F.zip_with(x, F.get(centres, k), lambda a, b: a - b)
    if inverse is None:
        return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, v: s + v * v))
    rows = F.transform(F.get(inverse, k), lambda row: F.aggregate(F.zip_with(row, d, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.zip_with(rows, d, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)))


class KMeansSolver(_Clusters):
    def prepared(self, df):
        rows = self.features(df)
        return Normalizer(p=1.0, inputCol="__features", outputCol="__normal").transform(rows) if self.p.normalize else rows

    def model(self, rows):
        found = KMeans(k=self.p.k, maxIter=self.p.max_iter, seed=self.p.seed, featuresCol="__normal" if self.p.normalize else "__features", predictionCol="__cluster").fit(rows)
        return found, np.array(found.clusterCenters()), None


class GMMSolver(_Clusters):
    def model(self, rows):
        found = GaussianMixture(k=self.p.k, maxIter=self.p.max_iter, tol=self.p.tol, seed=self.p.seed, featuresCol="__features", predictionCol="__cluster", probabilityCol="__p").fit(rows)
        g = found.gaussiansDF.collect()  # k rows
        return found, np.array([r["mean"].toArray() for r in g]), np.array([np.linalg.pinv(r["cov"].toArray()) for r in g])


class DBSCANSolver(_Vector):
    """Noise is an outlier.  Equal points are one weighted point.  The grid's cells have a diagonal of eps: a cell whose
    points weigh at least min_pts is all core and one cluster, so only points of light cells and cells' links look at
    neighbouring cells."""

    def labels(self, df: DataFrame) -> DataFrame:
        """Distinct points (x0, ..) with __cluster: the smallest point id of a cluster, or -1."""
        d, eps, least = len(self.columns), float(self.p.eps), self.p.min_pts
        xs = [f"x{i}" for i in range(d)]
        side = eps / math.sqrt(d)
        cell = [F.floor(F.col(x) / side).cast("long").alias(f"c{i}") for i, x in enumerate(xs)]
        points = df.select(*[F.col(c).cast("double").alias(x) for c, x in zip(self.columns, xs, strict=True)]).dropna().groupBy(*xs).agg(F.count(F.lit(1)).alias("w"))
        points = checkpoint(points.withColumn("id", F.monotonically_increasing_id()).select("*", *cell))
        cs = [f"c{i}" for i in range(d)]
        cells = checkpoint(points.groupBy(*cs).agg(F.sum("w").alias("cw"), F.min("id").alias("head")))
        reach = math.ceil(math.sqrt(d))
        steps = [s for s in np.ndindex(*(2 * reach + 1,) * d) if sum(max(0, abs(a - reach) - 1) ** 2 for a in s) * side * side <= eps * eps]
        near = F.explode(F.array(*[F.struct(*[(F.col(c) + int(a) - reach).alias(f"n{i}") for i, (c, a) in enumerate(zip(cs, s, strict=True))]) for s in steps]))
        other = points.select(*[F.col(x).alias(f"o{x}") for x in xs], F.col("w").alias("ow"), F.col("id").alias("oid"), *[F.col(c).alias(f"n{i}") for i, c in enumerate(cs)])
        apart = F.lit(0.0)
        for x in xs:
            apart = apart + (F.col(x) - F.col(f"o{x}")) ** 2
        keys = [f"n{i}" for i in range(d)]

        def around(left: DataFrame, right: DataFrame) -> DataFrame:
            return left.withColumn("n", near).select("*", "n.*").drop("n").join(right, keys).where(apart <= eps * eps)

        light = points.join(cells.where(F.col("cw") < least).select(*cs), cs)
        core_light = around(light, other).groupBy("id").agg(F.sum("ow").alias("n")).where(F.col("n") >= least).select("id")
        heavy = points.join(cells.where(F.col("cw") >= least).select(*cs, "head"), cs)
        core = checkpoint(heavy.select(*points.columns, "head").unionByName(points.join(core_light, "id").withColumn("head", F.col("id")).select(*points.columns, "head")))
        # one link between two heads is enough, however many of their points are near each other
        o = other.join(core.select(F.col("id").alias("oid"), F.col("head").alias("ohead")), "oid")
        links = around(core, o).where("head <> ohead").select(F.greatest("head", "ohead").alias("a"), F.least("head", "ohead").alias("b")).distinct()
        member = components(links)
        rooted = core.join(member, F.col("head") == F.col("node"), "left").select("id", F.coalesce("root", "head").alias("cluster"))
        rooted = checkpoint(rooted)
        rest = points.join(rooted, "id", "left_anti")
        border = around(rest, other.join(rooted.select(F.col("id").alias("oid"), "cluster"), "oid")).groupBy("id").agg(F.min("cluster").alias("cluster"))
        named = rooted.unionByName(border)
        return points.join(named, "id", "left").select(*xs, F.coalesce("cluster", F.lit(-1)).alias("__cluster"))

    def predict(self, df):
        labels = self.labels(df)
        on = F.lit(True)
        for i, c in enumerate(self.columns):
            on = on & (F.col(c).cast("double") == F.col(f"x{i}"))
        return df.join(labels, on, "left").withColumn(FLAG, F.col("__cluster") == -1).select(*df.columns, FLAG)


class LOFSolver(_Vector):
    """Local outlier factors from exact nearest neighbours, found block against block in numpy; equal points are one, so
    that no neighbour is at distance zero."""

    def scores(self, df: DataFrame) -> DataFrame:
        """Distinct points (x0, ..) with __lof."""
        xs, k, size = [f"x{i}" for i in range(len(self.columns))], self.p.min_pts, self.p.block
        raw = df.select(*[F.col(c).cast("double").alias(x) for c, x in zip(self.columns, xs, strict=True)]).dropna()
        points = checkpoint(raw.groupBy(*xs).agg(F.count(F.lit(1)).alias("w")).withColumn("id", F.monotonically_increasing_id()))
        n_blocks = max(1, math.ceil(points.count() / size))
        blocks = checkpoint(points.groupBy(F.pmod(F.xxhash64("id"), F.lit(n_blocks)).alias("blk")).agg(F.collect_list("id").alias("ids"), F.collect_list("w").alias("ws"), F.flatten(F.collect_list(F.array(*xs))).alias("xs")))
        pairs = blocks.crossJoin(blocks.select(F.col("ids").alias("ids2"), F.col("ws").alias("ws2"), F.col("xs").alias("xs2"))).repartition(max(8, n_blocks * n_blocks // 4))  # blocks, not rows
        dim = len(xs)

        def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for r in pdf.itertuples():
                    a, b = np.array(r.xs).reshape(-1, dim), np.array(r.xs2).reshape(-1, dim)
                    d = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(2))
                    d[d == 0] = np.inf
                    take = np.argsort(d, axis=1, kind="stable")[:, :k]
                    dist = np.take_along_axis(d, take, axis=1)
                    ok = np.isfinite(dist)
                    rows, cols = np.nonzero(ok)
                    yield pd.DataFrame({"id": np.array(r.ids)[rows], "other": np.array(r.ids2)[take[rows, cols]], "w": np.array(r.ws2)[take[rows, cols]], "d": dist[rows, cols]})

        found = pairs.mapInPandas(near, "id long, other long, w long, d double")
        # points stand for w rows each: the k nearest rows may be fewer points
        fold = lambda s, v: F.when(s["n"] >= k, s).otherwise(F.struct((s["n"] + v["w"]).alias("n"), F.concat(s["got"], F.array(F.struct(v["other"].alias("other"), F.least(v["w"], k - s["n"]).alias("w"), v["d"].alias("d")))).alias("got")))
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<other:bigint,w:bigint,d:double>>").alias("got"))
        best = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("d", "other", "w"))).alias("c")).select("id", F.aggregate("c", zero, fold, lambda s: s["got"]).alias("nn"))
        best = checkpoint(best.withColumn("kdist", F.element_at("nn", -1)["d"]))
        edges = best.select("id", F.explode("nn").alias("e")).select("id", "e.other", "e.w", "e.d")
        reach = edges.join(best.select(F.col("id").alias("other"), "kdist"), "other").groupBy("id").agg((F.sum("w") / F.sum(F.greatest("d", "kdist") * F.col("w"))).alias("lrd"))
        reach = checkpoint(reach)
        lof = edges.join(reach.select(F.col("id").alias("other"), F.col("lrd").alias("olrd")), "other").groupBy("id").agg((F.sum(F.col("olrd") * F.col("w")) / F.sum("w")).alias("mean"))
        return points.join(lof.join(reach, "id").select("id", (F.col("mean") / F.col("lrd")).alias("__lof")), "id", "left").select(*xs, F.coalesce("__lof", F.lit(1.0)).alias("__lof"))

    def predict(self, df):
        on = F.lit(True)
        for i, c in enumerate(self.columns):
            on = on & (F.col(c).cast("double") == F.col(f"x{i}"))
        scored = checkpoint(df.join(self.scores(df), on, "left").select(*df.columns, "__lof"))
        return scored.withColumn(FLAG, F.col("__lof") > F.lit(self.threshold(scored, "__lof"))).select(*df.columns, FLAG)


def path_constant(n: float) -> float:
    """Average path length of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow_forest(rows: DataFrame, dim: int, p: IForestParams) -> tuple[list[list[list[float]]], int]:
    """Trees, as lists of nodes (feature or -1, value, left, right, rows), the root first; and the rows of the largest.

    rows: x0, x1, .. and h, a hash that draws a tree's rows.  All trees grow together, one level in a pass over the rows:
    a task finds the node of each of its rows in each tree and gives the least and largest values of each open node, so
    what is shuffled and what the driver gets is bounded by trees x 2^depth, and every row counts, however many there are.
    """
    xs, spark = [f"x{i}" for i in range(dim)], rows.sparkSession
    n = rows.count()
    rate = min(1.0, p.max_samples if p.max_samples <= 1 else p.max_samples / max(n, 1))
    take = max(1, round(p.max_features * dim))
    usable = [set(np.random.default_rng([p.seed, t]).choice(dim, take, replace=False).tolist()) for t in range(p.num_trees)]
    trees: list[list[list[float]]] = [[[-1, 0.0, -1, -1, 0]] for _ in range(p.num_trees)]
    opened = [[0] for _ in range(p.num_trees)]
    limit = min(p.max_depth, math.ceil(math.log2(max(n * rate, 2))))
    poisson = np.cumsum([math.exp(-rate) * rate**k / math.factorial(k) for k in range(12)])
    schema = "tree int, node int, n long, " + ", ".join(f"lo{i} double, hi{i} double" for i in range(dim))
    for depth in range(limit + 1):
        shared = spark.sparkContext.broadcast(([np.array(t) for t in trees], opened))

        def level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            grown, wanted = shared.value  # noqa: B023
            best: dict[tuple[int, int], list[float]] = {}
            for pdf in batches:
                x, h = pdf[xs].to_numpy(), pdf["h"].to_numpy()
                for t, nodes in enumerate(grown):
                    if not wanted[t]:
                        continue
                    mixed = (h.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15 * (t + 1) % (1 << 64))) * np.uint64(0xD6E8FEB86659FD93)
                    draw = ((mixed ^ (mixed >> np.uint64(32))) & np.uint64((1 << 30) - 1)).astype(float) / (1 << 30)
                    times = np.searchsorted(poisson, draw, side="right") if p.bootstrap else np.ones(len(x), int)  # with replacement: some rows none, some more
                    mine = (times > 0) if p.bootstrap else draw < rate
                    if not mine.any():
                        continue
                    part, counted = x[mine], times[mine]
                    at = leaves(nodes, part)
                    ask = np.zeros(len(nodes), bool)
                    ask[wanted[t]] = True
                    order = np.flatnonzero(ask[at])
                    order = order[np.argsort(at[order], kind="stable")]
                    if not len(order):
                        continue
                    new = np.flatnonzero(np.concatenate([[True], np.diff(at[order]) != 0]))
                    part, total = part[order], np.add.reduceat(counted[order], new)
                    ends = np.stack([np.minimum.reduceat(part, new, axis=0), np.maximum.reduceat(part, new, axis=0)], axis=2).reshape(len(new), -1)
                    for node, rows_, got in zip(at[order][new].tolist(), total.tolist(), ends.tolist(), strict=True):
                        old = best.get((t, node))
                        best[(t, node)] = [rows_, *got] if old is None else [old[0] + rows_, *(f(a, b) for f, a, b in zip([min, max] * dim, old[1:], got, strict=True))]
            if best:
                yield pd.DataFrame([[*k, int(v[0]), *v[1:]] for k, v in best.items()], columns=["tree", "node", "n", *[f"{e}{i}" for i in range(dim) for e in ("lo", "hi")]])

        ends = [f(f"{e}{i}").alias(f"{e}{i}") for i in range(dim) for e, f in (("lo", F.min), ("hi", F.max))]
        found = {(r.tree, r.node): r for r in rows.mapInPandas(level, schema).groupBy("tree", "node").agg(F.sum("n").alias("n"), *ends).collect()}
        nxt: list[list[int]] = [[] for _ in trees]
        for (t, node), r in sorted(found.items()):
            trees[t][node][4] = r.n
            spread = [i for i in sorted(usable[t]) if r[f"hi{i}"] > r[f"lo{i}"]]
            if depth < limit and r.n > 1 and spread:
                rng = np.random.default_rng([p.seed, t, node + 1])
                f = int(rng.choice(spread))
                trees[t][node][:4] = [f, float(rng.uniform(r[f"lo{f}"], r[f"hi{f}"])), len(trees[t]), len(trees[t]) + 1]
                nxt[t] += [len(trees[t]), len(trees[t]) + 1]
                trees[t] += [[-1, 0.0, -1, -1, 0], [-1, 0.0, -1, -1, 0]]
        opened = nxt
        if not any(opened):
            break
    return trees, max((int(t[0][4]) for t in trees), default=0)


def leaves(nodes: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The leaf that each row falls into."""
    f, left, right = nodes[:, 0].astype(int), nodes[:, 2].astype(int), nodes[:, 3].astype(int)
    at = np.zeros(len(x), int)
    while len(inner := np.flatnonzero(f[at] >= 0)):
        node = at[inner]
        at[inner] = np.where(x[inner, f[node]] < nodes[node, 1], left[node], right[node])
    return at


def path_lengths(nodes: np.ndarray, x: np.ndarray) -> np.ndarray:
    f, left, right = nodes[:, 0].astype(int), nodes[:, 2].astype(int), nodes[:, 3].astype(int)
    at, depth = np.zeros(len(x), int), np.zeros(len(x))
    while True:
        inner = np.flatnonzero(f[at] >= 0)
        if not len(inner):
            break
        node = at[inner]
        at[inner] = np.where(x[inner, f[node]] < nodes[node, 1], left[node], right[node])
        depth[inner] += 1
    return depth + np.array([path_constant(n) for n in nodes[:, 4]])[at]


class IForestSolver(_Scored):
    """The forest (at most trees x 2^depth nodes) is broadcast to the rows it scores."""

    def model(self, df):
        xs = [f"x{i}" for i in range(len(self.columns))]
        some = df.select(*[F.col(c).cast("double").alias(x) for c, x in zip(self.columns, xs, strict=True)]).dropna()
        rows, cores = some.withColumn("h", F.xxhash64(*xs, F.monotonically_increasing_id(), F.lit(self.p.seed))), df.sparkSession.sparkContext.defaultParallelism
        rows = checkpoint(rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows)
        trees, n = grow_forest(rows, len(xs), self.p)
        return [np.array(t) for t in trees], path_constant(max(n, 2))

    def scored(self, df, model):
        shared = df.sparkSession.sparkContext.broadcast(model)

        @F.pandas_udf("double")
        def anomaly(*cols: pd.Series) -> pd.Series:
            trees, norm = shared.value
            x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
            ok = ~np.isnan(x).any(1)
            out = np.full(len(x), np.nan)
            if ok.any():
                out[ok] = 2.0 ** (-np.mean([path_lengths(t, x[ok]) for t in trees], axis=0) / norm)
            return pd.Series(out)

        return df.withColumn("__score", F.nullif(anomaly(*[F.col(c).cast("double") for c in self.columns]), F.lit(float("nan"))))


class PCASolver(_Scored):
    def model(self, df):
        rows = self.features(df)
        if rows.isEmpty():
            return None
        k = min(self.p.k, len(self.columns))
        scaler = StandardScaler(withMean=True, withStd=True, inputCol="__features", outputCol="__scaled").fit(rows)
        pca = PCA(k=k, inputCol="__scaled", outputCol="__pca").fit(scaler.transform(rows))
        corr = np.nan_to_num(Correlation.corr(pca.transform(scaler.transform(rows)), "__pca").first()[0].toArray(), nan=0.0)
        np.fill_diagonal(corr, 1.0)
        return scaler, pca, np.linalg.pinv(corr)

    def scored(self, df, model):
        scaler, pca, inverse = model
        distance = _quadratic(vector_to_array("__pca"), _constant(np.zeros((1, len(inverse)))), _constant(inverse[None]), F.lit(0))
        some = pca.transform(scaler.transform(self.features(df))).withColumn("__score", distance).select(*df.columns, "__score")
        empty = F.lit(False)
        for c in self.columns:
            empty = empty | F.col(c).isNull()
        return some.unionByName(df.where(empty).withColumn("__score", F.lit(None).cast("double")))


class AutoEncoderSolver(_Scored):
    """Input, ReLU layer, sigmoid layer; mean squared error by Adam.  Every task trains on all its scaled rows; the tasks'
    weights, which start alike, are averaged by their rows."""

    def model(self, df):
        p, dim = self.p, len(self.columns)
        cols = [F.col(c).cast("double") for c in self.columns]
        r = df.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{g}{i}") for i, c in enumerate(cols) for g, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        if not r.n or any(r[f"m{i}"] is None for i in range(dim)):
            return None
        mean, sd = np.array([r[f"m{i}"] for i in range(dim)]), np.array([r[f"s{i}"] or 1.0 for i in range(dim)])

        def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            x = [pdf.to_numpy(dtype=float) for pdf in batches]
            if sum(map(len, x)):
                net = train_autoencoder(_squash(np.concatenate(x), mean, sd), p.hidden_size, p.batch_size, p.num_epochs, p.seed)
                flat = np.concatenate([a.ravel() for a in net])
                yield pd.DataFrame({"i": np.arange(len(flat)), "n": sum(map(len, x)), "v": flat})

        rows = df.select(*[c.alias(f"x{i}") for i, c in enumerate(cols)]).dropna()
        got = rows.mapInPandas(train, "i int, n long, v double").groupBy("i").agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("v")).orderBy("i").collect()  # one set of weights
        if not got:
            return None
        net, at, flat = new_autoencoder(dim, p.hidden_size, p.seed), 0, np.array([g.v for g in got])
        for a in net:
            a[...] = flat[at : at + a.size].reshape(a.shape)
            at += a.size
        return net, mean, sd

    def scored(self, df, model):
        net, mean, sd = model

        @F.pandas_udf("double")
        def error(*xs: pd.Series) -> pd.Series:
            x = _squash(np.column_stack([c.to_numpy(dtype=float) for c in xs]), mean, sd)
            return pd.Series(((reconstruct(net, x)[1] - x) ** 2).mean(1))

        return df.withColumn("__score", F.nullif(error(*[F.col(c).cast("double") for c in self.columns]), F.lit(float("nan"))))


def _squash(x: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """Standardised, then into (0, 1), which a sigmoid can reach."""
    return 1 / (1 + np.exp(-np.clip((x - mean) / sd, -30, 30)))


def reconstruct(net: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.maximum(x @ net[0] + net[1], 0)
    return h, 1 / (1 + np.exp(-np.clip(h @ net[2] + net[3], -30, 30)))


def new_autoencoder(d: int, hidden: int, seed: int) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    return [rng.normal(0, (2 / d) ** 0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, (hidden, d)), np.zeros(d)]


def train_autoencoder(x: np.ndarray, hidden: int, batch: int, epochs: int, seed: int, rate: float = 0.01) -> list[np.ndarray]:
    """Every epoch sees every row once."""
    net, rng = new_autoencoder(x.shape[1], hidden, seed), np.random.default_rng([seed, 1])
    m1, m2, t = [np.zeros_like(a) for a in net], [np.zeros_like(a) for a in net], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), batch):
            b = x[order[i : i + batch]]
            h, y = reconstruct(net, b)
            dy = 2 * (y - b) * y * (1 - y) / b.size
            dh = (dy @ net[2].T) * (h > 0)
            t += 1
            for a, g, u, v in zip(net, [b.T @ dh, dh.sum(0), h.T @ dy, dy.sum(0)], m1, m2, strict=True):
                u += 0.1 * (g - u)
                v += 0.001 * (g * g - v)
                a -= rate * (u / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return net


SOLVERS: dict[str, type[Solver]] = {
    "k_sigma": KSigma, "tukey": Tukey, "mad": MAD, "sma": SMA, "kmeans": KMeansSolver, "gmm": GMMSolver, "dbscan": DBSCANSolver,
    "lof": LOFSolver, "iforest": IForestSolver, "pca": PCASolver, "autoencoder": AutoEncoderSolver,
}


def solver(model: str, columns: str | tuple[str, ...] | list[str], params: Params | None = None, *, index_col: str = "id") -> Solver:
    if model not in SOLVERS:
        raise IllegalParameterError(f"unknown outlier model {model!r}")
    columns = (columns,) if isinstance(columns, str) else tuple(columns)
    return SOLVERS[model](columns, params if params is not None else PARAMS[model](), index_col)
