"""Isolation forest: distributed sampling, tree growth and scoring.

Training grows each tree on its own random sample of the rows, as the method
asks; the samples of all trees together are at most trees * sample_size rows.
All trees grow at once, one window step a level. Every draw is a hash of the
seed and what it is for, so a forest depends on its rows and seed alone and any
engine that hashes alike can grow it. Scoring is a vectorised function over a
broadcast forest, whose size is bounded by trees * (2 * sample_size - 1) nodes.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywatch.functions.ranks import exact_quantiles
from tallywatch.functions.samples import spread_sample
from tallywatch.functions.scale import is_small, with_row, written
from tallywatch.schema import ANOMALY_FEATURES, CONTAMINATION

NODE_SCHEMA = (
    "tree int, node int, feature int, threshold double, left int, right int, size int, depth int"
)
LEAF = -1
_STEPS = "array<struct<node: bigint, feature: int, threshold: double, size: int, depth: int>>"
# Scores are rounded to so many digits, so that equal rows stay equal whatever the order of a sum.
SCORE_DIGITS = 10
# Ship the small functions below with each task: executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def average_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    many = np.maximum(n, 3)
    full = 2.0 * (np.log(many - 1.0) + np.euler_gamma) - 2.0 * (many - 1.0) / many
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, full))


def draw(*parts: Column) -> Column:
    """A number in [0, 1) that depends on `parts` alone: 52 bits of their MD5."""
    digest = F.md5(F.concat_ws(",", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / 2.0**52


def grow_trees(sample: DataFrame, names: Sequence[str], seed: int, max_depth: int) -> DataFrame:
    """The nodes of all trees over `sample`, which has `tree` and the features.

    A node takes a random feature and a uniform cut between its extremes, until
    its rows are alike or it is `max_depth` deep. A level is one window over each node's rows. Rows are dealt by tree once and
    stay there; the children of node i are 2i + 1 and 2i + 2.
    """
    of_node = Window.partitionBy("tree", "_node")
    features = [F.col(f"`{c}`").alias(f"_x{i}") for i, c in enumerate(names)]
    xs = [f"_x{i}" for i in range(len(names))]
    ends = [
        f(x).over(of_node).alias(x + k) for x in xs for f, k in ((F.min, "lo"), (F.max, "hi"))
    ]
    rows = sample.select("tree", *features).withColumns(
        {"_node": F.lit(0).cast("long"), "_live": F.lit(True), "_path": F.array().cast(_STEPS)}
    )
    for depth in range(max_depth + 1):
        rows = rows.select("*", F.count("*").over(of_node).alias("_size"), *ends)
        usable = [
            F.when(
                F.col(x + "hi") > F.col(x + "lo"),
                F.struct(
                    F.lit(i).alias("i"),
                    F.col(x + "lo").alias("lo"),
                    F.col(x + "hi").alias("hi"),
                    F.col(x).alias("v"),
                ),
            )
            for i, x in enumerate(xs)
        ]
        rows = rows.withColumn("_usable", F.array_compact(F.array(*usable)))
        splits = F.col("_live") & (F.size("_usable") > 0) & F.lit(depth < max_depth)
        which = draw(F.lit(seed), F.col("tree"), F.col("_node"), F.lit("feature"))
        pick = F.get("_usable", F.floor(which * F.size("_usable")).cast("int"))
        rows = rows.withColumn("_pick", F.when(splits, pick))
        share = draw(F.lit(seed), F.col("tree"), F.col("_node"), F.lit("cut"))
        cut = F.col("_pick.lo") + share * (F.col("_pick.hi") - F.col("_pick.lo"))
        rows = rows.withColumn("_cut", cut)
        step = F.struct(
            F.col("_node").alias("node"),
            F.coalesce("_pick.i", F.lit(LEAF)).alias("feature"),
            F.coalesce("_cut", F.lit(0.0)).alias("threshold"),
            F.col("_size").cast("int").alias("size"),
            # The same text at every level, so that Spark compiles it once.
            F.size("_path").alias("depth"),
        )
        goes_right = (F.col("_pick.v") > F.col("_cut")).cast("long")
        path = F.when(F.col("_live"), F.array_append("_path", step)).otherwise(F.col("_path"))
        rows = rows.select(
            "tree",
            *xs,
            F.coalesce(2 * F.col("_node") + 1 + goes_right, "_node").alias("_node"),
            F.col("_pick").isNotNull().alias("_live"),
            path.alias("_path"),
        )
    # Rows of one node carry the same step: one is kept of each.
    nodes = rows.select("tree", F.explode("_path").alias("s")).select("tree", "s.*").distinct()
    child = [F.when(F.col("feature") != LEAF, 2 * F.col("node") + k).otherwise(LEAF) for k in (1, 2)]
    return nodes.select(
        F.col("tree").cast("int").alias("tree"),
        F.col("node").cast("int").alias("node"),
        "feature",
        "threshold",
        child[0].cast("int").alias("left"),
        child[1].cast("int").alias("right"),
        "size",
        "depth",
    )


def flatten_forest(nodes: pd.DataFrame, sample_size: int) -> dict:
    """All trees as flat arrays, for `score_points`.

    A leaf is its own child, so every row can take the same number of steps.
    The children of node i are at 2i (left) and 2i + 1 (right).
    """
    nodes = nodes.sort_values(["tree", "node"], ignore_index=True)
    roots = np.flatnonzero(nodes["node"].to_numpy() == 0)
    here = np.arange(len(nodes))
    split = nodes["feature"].to_numpy() != LEAF
    tree = nodes["tree"].to_numpy(dtype=np.int64) << 32
    key = tree + nodes["node"].to_numpy()
    left, right = (
        np.where(split, np.searchsorted(key, tree + nodes[side].to_numpy()), here)
        for side in ("left", "right")
    )
    return {
        "roots": roots,
        "steps": int(nodes["depth"].max()),
        "children": np.column_stack([left, right]).ravel(),
        "feature": np.where(split, nodes["feature"].to_numpy(), 0),
        "threshold": nodes["threshold"].to_numpy(),
        "path": nodes["depth"].to_numpy() + average_path(nodes["size"].to_numpy()),
        "normal": float(average_path(np.array([sample_size]))[0]) or 1.0,
    }


def score_points(forest: dict, points: np.ndarray) -> np.ndarray:
    """2 ** -(mean path / normal path) per row, one tree after the other."""
    rows, width = points.shape
    flat, first = np.ascontiguousarray(points).ravel(), np.arange(rows) * width
    total = np.zeros(rows)
    for root in forest["roots"]:
        at = np.full(rows, root)
        for _ in range(forest["steps"]):
            value = flat.take(first + forest["feature"].take(at))
            goes_right = value > forest["threshold"].take(at)
            at = forest["children"].take(2 * at + goes_right)
        total += forest["path"].take(at)
    score = np.power(2.0, -total / len(forest["roots"]) / forest["normal"])
    return np.round(score, SCORE_DIGITS)


def _assign(pool: DataFrame, rows: int, trees: int, sample_size: int, seed: int) -> DataFrame:
    """(features, slot, tree): `sample_size` distinct slots for each tree."""
    if rows >= trees * sample_size:
        # Slots follow the hash order, so every trees-th slot is a random sample.
        return pool.withColumn("tree", (F.col("slot") % trees).cast("int"))
    # Fewer rows than the pool can hold: each tree draws from all of them.
    ids = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    drawn = pool.withColumn("tree", ids)
    if rows <= sample_size:
        return drawn
    drawn = drawn.withColumn("_draw", F.md5(F.concat_ws(",", F.lit(str(seed)), "tree", "slot")))
    order = Window.partitionBy("tree").orderBy("_draw", "slot")
    return drawn.withColumn("_place", F.row_number().over(order)).where(
        F.col("_place") <= sample_size
    )


@dataclass(frozen=True)
class Scaling:
    """Median filling and standard scaling, with statistics of the training data."""

    feature_cols: tuple[str, ...]
    medians: tuple[float, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]

    def filled(self, fills: Sequence[Column] | None = None) -> list[Column]:
        """One `filled_` column per feature; `fills` replace the training medians."""
        fills = [F.lit(m) for m in self.medians] if fills is None else fills
        return [
            F.coalesce(F.col(c).cast("double"), fill).alias(f"filled_{c}")
            for c, fill in zip(self.feature_cols, fills)
        ]

    def columns(
        self, fills: Sequence[Column] | None = None, source: Sequence[str] | None = None
    ) -> list[Column]:
        """One `scaled_` column per feature, from its own or the already filled column."""
        values = self.filled(fills) if source is None else [F.col(f"`{c}`") for c in source]
        parts = zip(self.feature_cols, values, self.means, self.scales)
        return [((v - mean) / scale).alias(f"scaled_{c}") for c, v, mean, scale in parts]


def fit_scaling(df: DataFrame, feature_cols: Sequence[str]) -> Scaling:
    """Medians, then means and population deviations of the filled features."""
    cols = list(feature_cols)
    medians = exact_quantiles(df, {f"m{i}": (c, 0.5) for i, c in enumerate(cols)}).first()
    if medians is None or any(m is None for m in medians):
        raise ValueError("every feature needs at least one value")
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in zip(cols, medians)]
    moments = df.agg(
        *[F.avg(v).alias(f"mean{i}") for i, v in enumerate(filled)],
        *[F.stddev_pop(v).alias(f"std{i}") for i, v in enumerate(filled)],
    ).first()
    return Scaling(
        tuple(cols),
        tuple(float(m) for m in medians),
        tuple(float(moments[f"mean{i}"]) for i in range(len(cols))),
        tuple(float(moments[f"std{i}"]) or 1.0 for i in range(len(cols))),
    )


@dataclass(frozen=True)
class IsolationForestModel:
    scaling: Scaling
    nodes: pd.DataFrame
    sample_size: int
    cut: float
    score_range: tuple[float, float]

    @property
    def feature_cols(self) -> tuple[str, ...]:
        return self.scaling.feature_cols

    def _score(self, df: DataFrame, fills: Sequence[Column] | None = None) -> Column:
        flat = flatten_forest(self.nodes, self.sample_size)
        forest = df.sparkSession.sparkContext.broadcast(flat)

        @F.pandas_udf("double")
        def score(*features: pd.Series) -> pd.Series:
            points = np.column_stack([f.to_numpy(dtype=float) for f in features])
            return pd.Series(score_points(forest.value, points))

        return score(*self.scaling.columns(fills))

    def _with_fills(self, df: DataFrame) -> tuple[DataFrame, list[Column]]:
        """`df` with its medians in `_m`, and these as columns."""
        medians = exact_quantiles(
            df, {f"m{i}": (c, 0.5) for i, c in enumerate(self.feature_cols)}
        )
        fills = [F.col(f"_m.m{i}") for i in range(len(self.feature_cols))]
        return with_row(df, medians, "_m"), fills

    def raw_scores(self, df: DataFrame) -> DataFrame:
        """Training scores: gaps take the training medians."""
        return df.withColumn("_score", self._score(df))

    def _finish(self, scored: DataFrame, low: Column, high: Column) -> DataFrame:
        anomaly = F.col("_score") - F.lit(self.cut)
        return (
            scored.withColumns(
                {
                    "is_anomaly": anomaly > 0,
                    "anomaly_score": anomaly,
                    "anomaly_score_normalized": (F.col("_score") - low)
                    / F.nullif(high - low, F.lit(0.0)),
                }
            )
        ).drop("_score")

    def transform(self, df: DataFrame) -> DataFrame:
        """Scores for any frame; gaps take that frame's medians."""
        filled, fills = self._with_fills(df)
        scored = filled.withColumn("_score", self._score(df, fills)).drop("_m")
        if not is_small(df):
            # The range below needs all scores first; do not compute them twice.
            scored = written(scored, "scores")
        ends = scored.agg(F.min("_score").alias("lo"), F.max("_score").alias("hi"))
        return self._finish(with_row(scored, ends, "_e"), F.col("_e.lo"), F.col("_e.hi")).drop("_e")

    def tree_table(self, spark) -> DataFrame:
        return spark.createDataFrame(self.nodes, NODE_SCHEMA)


@dataclass(frozen=True)
class IsolationForest:
    contamination: float = CONTAMINATION
    seed: int = 42
    trees: int = 100
    max_samples: int = 256

    def _grow(self, train: DataFrame, cols: list[str]) -> IsolationForestModel:
        """Trees over the stored table `train`, without a cut for anomalies yet."""
        scaling = fit_scaling(train, cols)
        # Rows are drawn by their values before scaling, which hold no rounding of their own.
        filled = train.select(*scaling.filled())
        rows = filled.count()
        sample = min(self.max_samples, rows)
        size = min(rows, self.trees * sample)
        pool = spread_sample(filled, filled.columns, rows, size, self.seed)
        assigned = _assign(pool, rows, self.trees, sample, self.seed)
        scaled = assigned.select("tree", *scaling.columns(source=filled.columns))
        depth = math.ceil(math.log2(max(sample, 2)))
        # At most trees * sample_size rows: one shuffle deals them by tree for all levels.
        tasks = min(self.trees, train.sparkSession.sparkContext.defaultParallelism)
        scaled = scaled.repartition(tasks, "tree")
        nodes = grow_trees(scaled, scaled.columns[1:], self.seed, depth).toPandas()
        nodes = nodes.sort_values(["tree", "node"], ignore_index=True)
        return IsolationForestModel(scaling, nodes, sample, 0.0, (0.0, 0.0))

    def _calibrate(self, draft: IsolationForestModel, scored: DataFrame) -> IsolationForestModel:
        """Set the cut so that the contaminated share of the training rows lies above."""
        cut = exact_quantiles(scored, {"cut": ("_score", 1 - self.contamination)}).first()[0]
        ends = scored.agg(F.min("_score"), F.max("_score")).first()
        return replace(draft, cut=float(cut), score_range=(ends[0], ends[1]))

    def fit(self, df: DataFrame, feature_cols: Sequence[str]) -> IsolationForestModel:
        cols = list(feature_cols)
        # Several passes follow: keep the few columns they need, lineage cut.
        train = written(df.select(*cols), "forest-input")
        draft = self._grow(train, cols)
        scores = draft.raw_scores(train).select("_score")
        return self._calibrate(draft, written(scores, "forest-scores"))

    def fit_predict(
        self, df: DataFrame, feature_cols: Sequence[str]
    ) -> tuple[IsolationForestModel, DataFrame]:
        """The model and the scored rows, each row scored a single time."""
        cols = list(feature_cols)
        draft = self._grow(written(df.select(*cols), "forest-input"), cols)
        scored = written(draft.raw_scores(df), "forest-scored")
        model = self._calibrate(draft, scored)
        return model, model._finish(scored, *map(F.lit, model.score_range))


class AnomalyDetector:
    """Holds a fitted model; predicting before fitting is an error."""

    def __init__(self, contamination: float | None = None, random_state: int = 42):
        self.contamination = CONTAMINATION if contamination is None else contamination
        self.random_state = random_state
        self.model: IsolationForestModel | None = None
        self.feature_names: list[str] | None = None

    def fit(self, df: DataFrame, feature_cols: Sequence[str]) -> AnomalyDetector:
        self.feature_names = list(feature_cols)
        forest = IsolationForest(self.contamination, self.random_state)
        self.model = forest.fit(df, self.feature_names)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            raise RuntimeError("Model not fitted. Call fit() first.")
        return self.model.transform(df)

    def fit_predict(self, df: DataFrame, feature_cols: Sequence[str]) -> DataFrame:
        self.feature_names = list(feature_cols)
        forest = IsolationForest(self.contamination, self.random_state)
        self.model, scored = forest.fit_predict(df, self.feature_names)
        return scored


def detect_anomalies(
    df: DataFrame,
    feature_cols: Sequence[str] | None = None,
    contamination: float | None = None,
) -> DataFrame:
    """Flag and score rows; with fewer than two features nothing is flagged."""
    if feature_cols is None:
        feature_cols = [c for c in ANOMALY_FEATURES if c in df.columns]
    if len(feature_cols) < 2:
        return df.withColumns({"is_anomaly": F.lit(False), "anomaly_score": F.lit(0.0)})
    return AnomalyDetector(contamination).fit_predict(df, feature_cols)


def feature_importance(model: IsolationForestModel, spark) -> DataFrame:
    """Share of rows split on each feature, over all nodes of all trees."""
    names = F.array(*[F.lit(c) for c in model.feature_cols])
    splits = model.tree_table(spark).where(F.col("feature") != LEAF)
    weight = splits.groupBy(F.get(names, F.col("feature")).alias("feature")).agg(
        F.sum("size").alias("weight")
    )
    return _shares(weight)


def _shares(weight: DataFrame) -> DataFrame:
    total = weight.agg(F.sum("weight").alias("t")).scalar()
    return weight.select("feature", (F.col("weight") / total).alias("importance")).orderBy(
        F.desc("importance"), "feature"
    )


def count_visits(forest: dict, points: np.ndarray) -> np.ndarray:
    """How many rows pass each node, leaves included, in the order of the flat arrays."""
    rows, width = points.shape
    flat, first = np.ascontiguousarray(points).ravel(), np.arange(rows) * width
    visits = np.zeros(len(forest["threshold"]), np.int64)
    for root in forest["roots"]:
        at = np.full(rows, root)
        visits[root] += rows
        for _ in range(forest["steps"]):
            value = flat.take(first + forest["feature"].take(at))
            to = forest["children"].take(2 * at + (value > forest["threshold"].take(at)))
            moved = to != at
            visits += np.bincount(to[moved], minlength=len(visits))
            at = to
    return visits


def anomaly_visits(model: IsolationForestModel, df: DataFrame) -> DataFrame:
    """(tree, node, visits): how often the rows of `df` that the model flags pass each node.

    Rows are scored and counted in one go; gaps take the medians of `df`, as in
    `transform`. Each task counts its own rows, so at most one row for each node
    and task is shuffled.
    """
    filled, fills = model._with_fills(df)
    flat = flatten_forest(model.nodes, model.sample_size)
    forest = df.sparkSession.sparkContext.broadcast(flat)
    nodes, cut = model.nodes.sort_values(["tree", "node"], ignore_index=True), model.cut

    def count(batches):
        total = np.zeros(len(nodes), np.int64)
        for batch in batches:
            points = batch.to_numpy(dtype=float)
            total += count_visits(forest.value, points[score_points(forest.value, points) > cut])
        seen = np.flatnonzero(total)
        yield nodes.loc[seen, ["tree", "node"]].assign(visits=total[seen])

    per_task = filled.select(*model.scaling.columns(fills)).mapInPandas(
        count, "tree int, node int, visits long"
    )
    return per_task.groupBy("tree", "node").agg(F.sum("visits").alias("visits"))


def anomaly_importance(model: IsolationForestModel, df: DataFrame) -> DataFrame:
    """Share of each feature in what sets the flagged rows of `df` apart.

    A split counts, for every flagged row that passes it, by how many times it
    halves the rows beside that one: log2 of the node's size over that of the
    child the row goes to. Deeper splits count less, by 1 / (depth + 1), as most
    rows are alone at some depth. No row if nothing is flagged.
    """
    spark = df.sparkSession
    names = F.array(*[F.lit(c) for c in model.feature_cols])
    nodes = model.tree_table(spark).select("tree", "node", "size")
    child = nodes.join(anomaly_visits(model, df), ["tree", "node"])
    child = child.select("tree", F.col("node").alias("child"), F.col("size").alias("rows"), "visits")
    splits = model.tree_table(spark).where(F.col("feature") != LEAF)
    sides = splits.withColumn("child", F.explode(F.array("left", "right")))
    gain = F.col("visits") * F.log2(F.col("size") / F.col("rows")) / (F.col("depth") + 1)
    weight = sides.join(child, ["tree", "child"]).groupBy(
        F.get(names, F.col("feature")).alias("feature")
    )
    return _shares(weight.agg(F.sum(gain).alias("weight")))
