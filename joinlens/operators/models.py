"""Learned estimators: tree ensembles and linear models of pyspark.ml, and a network over sets of tables, joins and filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.functions import array_to_vector
from pyspark.ml.feature import MinMaxScaler, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows on which the network is trained, drawn by hash; the tree and linear models use all rows.
TRAINING_ROWS = 20_000


def _regressor(kind: str, seed: int):
    options = {"featuresCol": "__in", "labelCol": "label", "predictionCol": "prediction"}
    if kind == "xgboost":
        return GBTRegressor(maxIter=20, maxDepth=5, seed=seed, **options)
    if kind == "rf":
        return RandomForestRegressor(numTrees=20, maxDepth=8, seed=seed, **options)
    if kind == "linear":
        return LinearRegression(regParam=0.01, **options)
    raise ValueError(f"unknown model {kind}; known: xgboost, rf, linear")


def fit_predict(train: DataFrame, test: DataFrame, columns: list[str], target: str, kind: str, seed: int = 0, scale: str | None = None, search: bool = False) -> DataFrame:
    """test with a column est: the model is fitted to the logarithm of target (1 at least) on train.

    columns: numbers or arrays of numbers. search tries a small grid by cross-validation.
    """
    label = F.ln(F.greatest(F.col(target).cast("double"), F.lit(1.0)))
    arrays = [c for c in columns if train.schema[c].dataType.typeName() == "array"]
    train, test = (df.withColumns({f"__v_{c}": array_to_vector(c) for c in arrays}) for df in (train, test))
    columns = [f"__v_{c}" if c in arrays else c for c in columns]
    stages = [VectorAssembler(inputCols=columns, outputCol="__raw" if scale else "__in", handleInvalid="error" if arrays else "keep")]
    if scale:
        stages.append((MinMaxScaler if scale == "minmax" else StandardScaler)(inputCol="__raw", outputCol="__in"))
    model = _regressor(kind, seed)
    pipeline = Pipeline(stages=[*stages, model])
    rows = train.withColumn("label", label)
    if search:
        grid = ParamGridBuilder().addGrid(model.maxDepth, [3, 6]).build() if kind != "linear" else ParamGridBuilder().addGrid(model.regParam, [0.001, 0.1]).build()
        fitted = CrossValidator(estimator=pipeline, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol="label"), numFolds=3, seed=seed).fit(rows)
    else:
        fitted = pipeline.fit(rows)
    made = fitted.transform(test)
    # an extrapolated logarithm may be far off: what exceeds the labels by more than a factor of e is cut there
    top = rows.agg(F.max("label")).first()[0] or 0.0
    return made.withColumn("est", F.greatest(F.exp(F.least("prediction", F.lit(top + 1.0))), F.lit(1.0))).drop("__raw", "__in", "prediction", *(f"__v_{c}" for c in arrays))


def loss_slope(kind: str, d: np.ndarray) -> np.ndarray:
    """Slope of a loss by the predicted logarithm; d is predicted less true logarithm.

    mse: squared; abs: absolute; qloss: larger over smaller; rel: relative error; weighted: relative plus q-error. Errors
    count up to e^4, so that single rows do not carry a step away.
    """
    cut = np.clip(d, -4, 4)
    q, rel = np.sign(cut) * np.exp(np.abs(cut)), np.sign(cut) * np.exp(cut)
    return {"mse": 2 * d, "abs": np.sign(d), "qloss": q, "rel": rel, "weighted": rel + q}[kind]


class SetNetwork:
    """Two layers for the elements of each set (tables, joins, filters), their masked mean, and two layers over all means and
    the scalars. Trained by Adam on mini-batches to the logarithm of the target."""

    SETS = ("tables", "joins", "filters")

    def __init__(self, widths: dict[str, int], hidden: int = 32, seed: int = 0):
        self.widths, self.seed = widths, seed
        rng = np.random.default_rng(seed)
        self.sizes = {"tables": widths["tables"], "joins": widths["joins"], "filters": widths["columns"] + widths["operators"] + widths["hashes"] + 2}

        def layer(n: int, m: int) -> list[np.ndarray]:
            return [rng.normal(0, np.sqrt(2 / max(n, 1)), (n, m)), np.zeros(m)]

        self.w: list[np.ndarray] = []
        for name in self.SETS:
            self.w += layer(self.sizes[name], hidden) + layer(hidden, hidden)
        self.w += layer(3 * hidden + widths["scalars"], hidden) + layer(hidden, 1)

    def tensors(self, batch: pa.RecordBatch | pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
        """(elements padded to the longest set, mask) of each set, and the scalars with an empty mask."""
        made = []
        for name in self.SETS:
            lists = batch.column(name)
            lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
            sizes = np.diff(lists.offsets.to_numpy()) * lists.is_valid().to_numpy(zero_copy_only=False)
            flat, longest = lists.flatten(), max(1, int(sizes.max(initial=0)))
            row = np.repeat(np.arange(len(sizes)), sizes)
            at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            x, mask = np.zeros((len(sizes), longest, self.sizes[name]), np.float32), np.zeros((len(sizes), longest), np.float32)
            mask[row, at] = 1
            if name == "filters":
                c, o, h, lo, hi = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(5))
                first = self.widths["columns"]
                x[row, at, c] = x[row, at, first + o] = x[row, at, first + self.widths["operators"] + h] = 1
                x[row, at, -2], x[row, at, -1] = lo, hi
            else:
                x[row, at, flat.to_numpy()] = 1
            made.append((x, mask))
        scalars = batch.column("scalars")
        scalars = scalars.combine_chunks() if isinstance(scalars, pa.ChunkedArray) else scalars
        made.append((scalars.flatten().to_numpy().reshape(len(scalars), -1), np.zeros(0)))
        return made

    def forward(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, list]:
        means, kept = [], []
        for k, (x, mask) in enumerate(parts[:3]):
            w1, b1, w2, b2 = self.w[4 * k : 4 * k + 4]
            one = np.maximum(x @ w1 + b1, 0)
            two = np.maximum(one @ w2 + b2, 0)
            share = (mask / np.maximum(mask.sum(1, keepdims=True), 1))[:, :, None]
            means.append((two * share).sum(1))
            kept.append((x, one, two, share))
        z = np.concatenate([*means, parts[3][0]], 1)
        h = np.maximum(z @ self.w[12] + self.w[13], 0)
        return (h @ self.w[14] + self.w[15])[:, 0], [kept, z, h]

    def slopes(self, kept: list, by_y: np.ndarray) -> list[np.ndarray]:
        """Slopes of the loss by all weights, given those by the outputs."""
        sets, z, h = kept
        d = by_y[:, None]
        dh = (d @ self.w[14].T) * (h > 0)
        dz, out = dh @ self.w[12].T, []
        width = self.w[2].shape[1]
        for k, (x, one, two, share) in enumerate(sets):
            d2 = dz[:, None, k * width : (k + 1) * width] * share * (two > 0)
            d1 = (d2 @ self.w[4 * k + 2].T) * (one > 0)
            out += [np.einsum("bmi,bmj->ij", x, d1, optimize=True), d1.sum((0, 1)), np.einsum("bmi,bmj->ij", one, d2, optimize=True), d2.sum((0, 1))]
        return [*out, z.T @ dh, dh.sum(0), h.T @ d, d.sum(0)]

    def fit(self, parts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, loss: str = "mse", epochs: int = 20, rate: float = 0.003, size: int = 256) -> SetNetwork:
        rng = np.random.default_rng(self.seed)
        self.w[15] = self.w[15] + (y.mean() if len(y) else 0.0)
        self.top = float(y.max(initial=0.0)) + 1.0
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for a in range(0, len(y), size):
                pick, t = order[a : a + size], t + 1
                out, kept = self.forward([(x[pick], mask[pick] if mask.size else mask) for x, mask in parts])
                for i, g in enumerate(self.slopes(kept, loss_slope(loss, out - y[pick]) / len(pick))):
                    m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                    self.w[i] = self.w[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        return self

    def predict(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return np.clip(self.forward(parts)[0], 0.0, self.top)


def network_predict(train: DataFrame, test: DataFrame, widths: dict[str, int], target: str, keep: list[str], loss: str = "mse", seed: int = 0) -> DataFrame:
    """(keep..., est) of test by a SetNetwork, trained on at most about TRAINING_ROWS rows of train (of features.set_features)."""
    n = max(1, train.count())
    part = min(1.0, TRAINING_ROWS / n)
    columns = [*SetNetwork.SETS, "scalars"]
    drawn = train.where(F.pmod(F.xxhash64(F.lit(seed), *keep), F.lit(1_000_000)) < part * 1_000_000)
    table = drawn.select(*columns, F.ln(F.greatest(F.col(target).cast("double"), F.lit(1.0))).alias("__y")).toArrow()  # about TRAINING_ROWS rows
    net = SetNetwork(widths, seed=seed)
    net.fit(net.tensors(table), table.column("__y").to_numpy(), loss)
    shared = test.sparkSession.sparkContext.broadcast(net)
    narrow = test.select(*keep, *columns)
    schema = test.select(*keep).withColumn("est", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 2048):
                batch = whole.slice(a, 2048)
                est = np.exp(shared.value.predict(shared.value.tensors(batch))) if batch.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(est.astype(float))], [*batch.schema.names[: len(keep)], "est"])

    return narrow.mapInArrow(run, schema)


def singular_energy(cells: DataFrame, group: str, row: str, column: str, value: str) -> DataFrame:
    """(group, k, singular, energy, kept): singular values of each group's column by row matrix, cumulative energy, and whether
    the optimal hard threshold keeps them.

    The Gram matrix of the columns (sub-plans of a template: some dozens) is summed by Spark, however many rows there are;
    each group's is decomposed in one task.
    """
    pairs = cells.select(group, row, F.col(column).alias("a"), F.col(value).cast("double").alias("x"))
    gram = pairs.join(pairs.withColumnsRenamed({"a": "b", "x": "y"}), [group, row]).groupBy(group, "a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("__gram"))
    rows = pairs.groupBy(group).agg(F.count_distinct(row).alias("n_rows"))

    def one(frame):
        names = sorted(set(frame["a"]))
        at = {n: i for i, n in enumerate(names)}
        g = np.zeros((len(names), len(names)))
        g[frame["a"].map(at), frame["b"].map(at)] = frame["__gram"]
        s = np.sqrt(np.maximum(np.linalg.eigvalsh(g)[::-1], 0.0))
        n_rows = int(frame["n_rows"].iloc[0])
        s = s[: min(len(s), n_rows)]
        beta = min(len(names), n_rows) / max(len(names), n_rows, 1)
        omega = 0.56 * beta**3 - 0.95 * beta**2 + 1.82 * beta + 1.43
        energy = np.cumsum(s) / max(s.sum(), 1e-300)
        return type(frame)({group: frame[group].iloc[0], "k": np.arange(1, len(s) + 1), "singular": s, "energy": energy, "kept": s > omega * np.median(s)})

    return gram.join(rows, group).groupBy(group).applyInPandas(one, f"`{group}` string, k int, singular double, energy double, kept boolean")
