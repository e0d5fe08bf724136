"""Model training, evaluation and composition on Spark ML.

Every fit is a Spark ML estimator over the assembled feature vector; what
reaches the driver is a fitted model, importances or a metrics row - never
the rows.  Folded / repeated work (cross-validation, permutation importance)
is expressed as columns on one frame that is persisted once and reused.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LinearSVC, LinearSVCModel, LogisticRegression,
                                       MultilayerPerceptronClassifier, OneVsRest, OneVsRestModel, RandomForestClassifier)
from pyspark.ml.common import _py2java
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from vitalis import ship_package
from vitalis.functions.columns import md5_unit
from vitalis.operators.gram import gram
from vitalis.operators import forest, machines
from vitalis.operators import metrics as M
from vitalis.operators.clean import Scaler
from vitalis.operators.split import kfold, stratified_kfold
from vitalis.session import written

#: Parameters each kind of model takes.
PARAMS = {
    "rf": {"n_estimators", "max_depth", "min_samples_split", "min_samples_leaf", "weight_col"},
    "gb": {"n_estimators", "max_depth", "min_samples_split", "min_samples_leaf", "learning_rate", "weight_col"},
    "svm": {"reg", "max_iter", "n_components", "gamma"},
    "mlp": {"hidden", "max_iter"},
    "elastic": {"alpha", "l1_ratio", "reg", "max_iter", "weight_col"},
    "logistic": {"reg", "C", "l1_ratio", "max_iter", "weight_col"},
    "linear": {"reg", "l1_ratio", "max_iter", "weight_col"},
}
PARAMS["en"] = PARAMS["elastic"]
#: Depth of a tree without a limit: the most that Spark's trees take.
DEEPEST = 30
#: A forest with deeper trees than this is grown tree by tree (``forest``).
DEEP = 12
#: Bins that Spark's trees cut a feature into.
BINS = 32
#: More rows than this are added up by their bins before trees are grown; the bootstrap of a forest has about as many shares to draw from, or one per cell if there are more cells.
SHARES = 1 << 17
#: Numbers that the classes of a machine hold in memory at once, 8 bytes each; beyond that one class is fitted after the other.
HELD = 1 << 28
#: Beyond so many components the machines of all classes are fitted in the same passes, each of which makes the components anew.
WIDE = 1 << 27
#: Combinations of bins that a model of trees answers once, for rows to look up; the answers are sent to every task.
GRID = 1 << 20
#: Rows of a permutation that are put in order at once.
STRETCH = 2000
MODEL_KINDS = ("rf", "gb", "svm", "mlp", "elastic", "en", "logistic", "linear")


def infer_task(df: DataFrame, label: str) -> str:
    """'regression' iff the label is numeric with more than 10 distinct values, else 'classification'."""
    if isinstance(df.schema[label].dataType, NumericType):
        few = df.where(F.col(label).isNotNull()).select(label).distinct().limit(11).count()
        return "regression" if few > 10 else "classification"
    return "classification"


def rff_weights(p: int, n_components: int = 100, gamma: float | None = None, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Weights (component x feature) and shifts of random Fourier features."""
    rng = np.random.default_rng(seed)
    gamma = gamma if gamma is not None else 1.0 / p
    W = rng.normal(0.0, math.sqrt(2 * gamma), size=(n_components, p))
    return W, rng.uniform(0, 2 * math.pi, size=n_components)


def rff_columns(features: Sequence[str], n_components: int = 100, gamma: float | None = None, seed: int = 42,
                prefix: str = "_rff") -> list[Column]:
    """Random Fourier features (Rahimi & Recht 2007) of standardised inputs for an RBF kernel, as expressions.

    z_i(x) = sqrt(2 / D) * cos(w_i . x + b_i), w ~ N(0, 2 gamma), b ~ U(0, 2 pi);
    gamma defaults to 1 / n_features (inputs are standardised).
    """
    W, b = rff_weights(len(features), n_components, gamma, seed)
    scale = math.sqrt(2.0 / n_components)
    out = []
    for i in range(n_components):
        dot = F.lit(float(b[i]))
        for j, f in enumerate(features):
            dot = dot + F.lit(float(W[i, j])) * F.col(f)
        out.append((F.lit(scale) * F.cos(dot)).alias(f"{prefix}{i}"))
    return out


def bin_edges(df: DataFrame, features: Sequence[str], bins: int = BINS) -> list[list[float]]:
    """Inner edges of each feature's bins, from all rows: halfway between its values where they are at most ``bins``, else after its quantiles."""
    x = [F.col(f).cast("double") for f in features]
    at = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(c, at, 10000).alias(f"q{i}") for i, c in enumerate(x)],
                 *[F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(x)]).first()
    few = [i for i in range(len(x)) if row[f"d{i}"] <= 2 * bins]  # the count is good to some 5 %
    values = df.agg(*[F.collect_set(x[i]).alias(f"s{i}") for i in few]).first() if few else None
    out = []
    for i in range(len(x)):
        v = sorted(filter(math.isfinite, values[f"s{i}"])) if i in few else []
        if i in few and len(v) <= bins:
            out.append([m if a < (m := a / 2 + b / 2) <= b else b for a, b in zip(v, v[1:])])
        else:
            out.append(sorted({math.nextafter(q, math.inf) for q in row[f"q{i}"] or () if math.isfinite(q)}))
    return out


@dataclass
class TabularModel:
    """rf / gb / svm / mlp / elastic (en) / logistic / linear over named feature columns, or an estimator of one's own.

    Classification labels of any type are indexed (class order = sorted labels)
    and predictions are mapped back to the original labels.  ``kind`` may be any Spark ML
    estimator of a label and a feature vector; ``params`` are then set on a copy of it.
    """

    kind: str | Estimator = "rf"
    task: str | None = None
    params: dict = field(default_factory=dict)
    seed: int = 42
    features_: list = field(default_factory=list)
    label_: str | None = None
    model_: PipelineModel | None = None
    labels_: list = field(default_factory=list)
    scaler_: Scaler | None = None
    extra_cols_: list = field(default_factory=list)
    label_type_: str = "string"

    def _leaf(self) -> int:
        """Rows that a split leaves on either side at least; n rows to split leave n // 2 at most on the smaller."""
        return max(1, self.params.get("min_samples_leaf", 1), self.params.get("min_samples_split", 2) // 2)

    def _estimator(self, n_features: int, n_classes: int, label_col: str, label_std: float | None, rows: int = 0):
        """The estimator; ``rows`` if its input is rows added up, with their numbers as weights."""
        k, p, reg = self.kind, self.params, self.task == "regression"
        if isinstance(k, Estimator):
            return k.copy({k.getParam(n): v for n, v in p.items()} | {k.getParam("labelCol"): label_col, k.getParam("featuresCol"): "features"})
        depth = p.get("max_depth", 10 if k == "rf" else 3)
        depth = DEEPEST if depth is None else depth
        leaf = self._leaf()
        least = {"minInstancesPerNode": leaf}
        if rows and leaf > 1:
            least = {"minInstancesPerNode": 1, "minWeightFractionPerNode": (leaf - 0.5) / rows}
        if k == "rf":
            cls = RandomForestRegressor if reg else RandomForestClassifier
            return cls(labelCol=label_col, featuresCol="features", numTrees=p.get("n_estimators", 100),
                       maxDepth=depth, cacheNodeIds=bool(rows), **least, seed=self.seed)
        if k == "gb":
            if reg:
                return GBTRegressor(labelCol=label_col, featuresCol="features", maxIter=p.get("n_estimators", 100),
                                    stepSize=p.get("learning_rate", 0.1), maxDepth=depth, **least, seed=self.seed)
            base = GBTClassifier(featuresCol="features", maxIter=p.get("n_estimators", 100),
                                 stepSize=p.get("learning_rate", 0.1), maxDepth=depth, **least, seed=self.seed)
            if n_classes <= 2:
                base.setLabelCol(label_col)
                return base
            return OneVsRest(classifier=base, labelCol=label_col, featuresCol="features", parallelism=min(n_classes, 8))
        if k == "svm":
            if reg:
                return LinearRegression(labelCol=label_col, featuresCol="features", loss="huber",
                                        regParam=p.get("reg", 0.01), elasticNetParam=0.0)
            base = LinearSVC(featuresCol="features", regParam=p.get("reg", 0.01), maxIter=p.get("max_iter", 100))
            return OneVsRest(classifier=base, labelCol=label_col, featuresCol="features", parallelism=min(n_classes, 8))
        if k == "mlp":
            if reg:
                raise ValueError("MLP regression has no distributed counterpart (see README)")
            return MultilayerPerceptronClassifier(labelCol=label_col, featuresCol="features",
                                                  layers=[n_features, p.get("hidden", 100), n_classes],
                                                  maxIter=p.get("max_iter", 500), seed=self.seed)
        if k in ("elastic", "en", "linear"):
            if reg:
                lam, l1 = (p.get("alpha", 1.0), p.get("l1_ratio", 0.5)) if k != "linear" else (0.0, 0.0)
                # Spark divides the L2 part by the label's population std; rescale to the textbook objective
                sigma = label_std or 1.0
                reg_param = lam * l1 + sigma * lam * (1 - l1)
                enet = (lam * l1 / reg_param) if reg_param > 0 else 0.0
                return LinearRegression(labelCol=label_col, featuresCol="features", regParam=reg_param,
                                        elasticNetParam=enet, standardization=False)
            k = "logistic"
        if k == "logistic":
            lr = LogisticRegression(labelCol=label_col, featuresCol="features", standardization=False,
                                    regParam=p.get("reg", 0.0), elasticNetParam=p.get("l1_ratio", 0.0),
                                    maxIter=p.get("max_iter", 100))
            if p.get("weight_col"):
                lr.setWeightCol(p["weight_col"])
            return lr
        raise ValueError(f"unknown model kind {k!r}")

    def fit(self, df: DataFrame, features: Sequence[str], label: str, stored: bool = False) -> "TabularModel":
        """``stored``: the rows are read from a table, which several passes may do as well as from a cache."""
        self.features_, self.label_ = list(features), label
        self.label_type_ = df.schema[label].dataType.simpleString()
        takes = {p.name for p in self.kind.params} if isinstance(self.kind, Estimator) else PARAMS.get(self.kind, set(self.params))
        unknown = set(self.params) - takes
        if unknown:
            raise ValueError(f"{self.kind} takes no parameter {sorted(unknown)}; it takes {sorted(takes)}")
        keep = {*features, label, *filter(None, [self.params.get("weight_col")])}
        df = df.select(*[c for c in df.columns if c in keep])
        if stored:
            return self._fit(df, features, label)
        df = df.persist()  # several passes read it
        try:
            return self._fit(df, features, label)
        finally:
            df.unpersist()

    def _fit(self, df: DataFrame, features: Sequence[str], label: str) -> "TabularModel":
        if self.task is None:
            self.task = infer_task(df, label)
        data = df
        feats = list(features)
        if self.kind == "svm":
            self.scaler_ = Scaler(feats, "standard").fit(df)
            self.extra_cols_ = rff_columns(feats, self.params.get("n_components", 100), seed=self.seed)
            data = self.scaler_.transform(df).select("*", *self.extra_cols_)
            feats = [f"_rff{i}" for i in range(len(self.extra_cols_))]
        label_col, label_std, n_classes = label, None, 0
        stages = []
        if self.task == "classification":
            # classes in string order; rows without a label teach nothing
            label_col = "_label_idx"
            data = data.where(F.col(label).isNotNull())
            self.labels_ = sorted(r[0] for r in data.select(F.col(label).cast("string")).distinct().collect())
            n_classes = len(self.labels_)
            place = F.array_position(F.array(*[F.lit(x) for x in self.labels_]), F.col(label).cast("string"))
            data = data.withColumn(label_col, (place - 1).cast("double"))
            if self.kind in ("logistic", "elastic", "en", "linear") and "reg" not in self.params:
                self.params = {**self.params, "reg": 1.0 / (self.params.get("C", 1.0) * max(data.count(), 1))}
        elif self.kind in ("elastic", "en"):
            label_std = df.agg(F.stddev_pop(F.col(label).cast("double"))).first()[0]
        *missing, rows = data.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in features], F.count(F.lit(1))).first()
        if any(missing):
            raise ValueError(f"features with nulls, impute them first: {[c for c, n in zip(features, missing, strict=True) if n]}")
        weight = self.params.get("weight_col")
        # beyond a weight, rows added up don't tell how many there are in a leaf
        added = self.kind in ("rf", "gb") and rows > SHARES and 2 * self._leaf() < rows and not (weight and self._leaf() > 1) and all(isinstance(data.schema[f].dataType, NumericType) for f in feats)
        if rows and self._deep(data, feats):
            self.model_ = self._forest(data, feats, label_col, n_classes, rows)
            if self.model_ is not None:
                return self
        est = self._estimator(len(feats), max(n_classes, 2), label_col, label_std, rows if added else 0)
        if self.kind == "svm":
            assembler = VectorAssembler(inputCols=feats, outputCol="features", handleInvalid="error")
            if self.task == "classification" and rows * len(feats) > WIDE:
                self.model_ = PipelineModel([assembler, self._machines_at_once(est, data, list(features), label_col, rows)])
                return self
            # each step of a fit sends its plan to every task: that of a table is short
            vectors = written(assembler.transform(data).select("features", label_col), "vectors")
            self.model_ = PipelineModel([assembler, est.fit(vectors) if self.task == "regression" else self._machines(est, vectors, label_col, rows * len(feats))])
            return self
        if not added:
            stages.append(VectorAssembler(inputCols=feats, outputCol="features", handleInvalid="error"))
            if weight and hasattr(est, "setWeightCol") and self.kind in ("rf", "gb"):
                est.setWeightCol(weight)
            stages.append(est)
            self.model_ = Pipeline(stages=stages).fit(data)
            return self
        cut = self._cut(data, feats)
        bins = cut.getOutputCols()
        cells = self._cells(cut.transform(data), bins, label_col).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            # a boosted tree takes every row, a forest's draw from the shares
            most = 1 if self.kind == "gb" else max(1, SHARES // max(1, cells.count()))
            parts = F.least("_n", F.lit(most).cast("long"))
            shares = cells.select(*bins, label_col, (F.col("_weight") / parts).alias("_weight"), F.explode(F.sequence(F.lit(1).cast("long"), parts)))
            shares = shares.drop("col").repartition(data.sparkSession.sparkContext.defaultParallelism)
            est.setWeightCol("_weight")
            fitted = Pipeline(stages=[VectorAssembler(inputCols=bins, outputCol="features", handleInvalid="error"), est]).fit(shares)
        finally:
            cells.unpersist()
        self.model_ = PipelineModel([cut, *fitted.stages])
        return self

    def _cut(self, data: DataFrame, feats: Sequence[str]) -> Bucketizer:
        return Bucketizer(inputCols=list(feats), outputCols=[f"_bin{i}" for i in range(len(feats))], handleInvalid="error",
                          splitsArray=[[-math.inf, *(e or [0.0]), math.inf] for e in bin_edges(data, feats)])

    def _deep(self, data: DataFrame, feats: Sequence[str]) -> bool:
        """Whether this is a forest of deep trees over numbers (the values of a marked category have no order)."""
        depth = self.params.get("max_depth", 10)
        depth = DEEPEST if depth is None else depth
        fields = [data.schema[f] for f in feats]
        return self.kind == "rf" and DEEP < depth <= DEEPEST and self.params.get("n_estimators", 100) >= 1 and all(isinstance(f.dataType, NumericType) and "ml_attr" not in f.metadata for f in fields)

    def _forest(self, data: DataFrame, feats: Sequence[str], label_col: str, n_classes: int, rows: int) -> "forest.DeepForest | None":
        """The forest on rows of equal bins and label added up (beyond SHARES rows: of equal bins); None if they are still too many for a task."""
        cut = self._cut(data, feats)
        units = self._cells(cut.transform(data), cut.getOutputCols(), label_col, rows <= SHARES).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            n, bad, weight = units.agg(F.count(F.lit(1)), F.count_if(~((F.abs(label_col) < math.inf) & (F.col("_weight") < math.inf))), F.sum("_weight")).first()
            if bad or not weight > 0:
                raise ValueError("labels must be finite numbers, weights finite, not negative and not all zero")
            if n > forest.CELLS:
                return None
            depth = self.params.get("max_depth")
            return forest.fit(units, cut, label_col, n_classes, int(self.params.get("n_estimators", 100)), DEEPEST if depth is None else depth, self._leaf(), self.seed)
        finally:
            units.unpersist()

    def _machines(self, est: OneVsRest, vectors: DataFrame, label_col: str, numbers: int) -> OneVsRestModel:
        """What ``est`` would fit.  Each class holds its copy of the vectors (``numbers`` in all) in memory: at most as many at once as HELD allows."""
        def one(i: int) -> LinearSVCModel:
            rows = vectors.select("features", (F.col(label_col) == i).cast("double").alias("_one"))
            return est.getClassifier().copy().setLabelCol("_one").setPredictionCol(est.getPredictionCol()).fit(rows)

        out = OneVsRestModel(models=side_by_side([lambda i=i: one(i) for i in range(len(self.labels_))], min(est.getParallelism(), max(1, HELD // max(1, numbers)))))
        for p in (est.classifier, est.featuresCol, est.labelCol):
            out.set(out.getParam(p.name), est.getOrDefault(p))
        return out

    def _machines_at_once(self, est: OneVsRest, data: DataFrame, features: list[str], label_col: str, rows: int) -> OneVsRestModel:
        """The same machines from a table of the scaled features: every pass serves all of them and holds a block of components."""
        sc, svc = data.sparkSession.sparkContext, est.getClassifier().copy().setLabelCol("_one").setPredictionCol(est.getPredictionCol())
        parts = max(4 * sc.defaultParallelism, rows >> 20)
        table = written(machines.packed(data, features, label_col).repartition(parts), "scaled")
        W, b = rff_weights(len(features), len(self.extra_cols_), seed=self.seed)
        found = machines.fit(table, len(self.labels_), W, b, svc.getRegParam(), svc.getMaxIter(), svc.getTol())
        made = [sc._jvm.org.apache.spark.ml.classification.LinearSVCModel(f"{svc.uid}_{i}", _py2java(sc, Vectors.dense(w)), c) for i, (w, c) in enumerate(found)]
        out = OneVsRestModel(models=[svc._copyValues(svc._create_model(m)) for m in made])
        for p in (est.classifier, est.featuresCol, est.labelCol):
            out.set(out.getParam(p.name), est.getOrDefault(p))
        return out

    def _cells(self, data: DataFrame, bins: Sequence[str], label_col: str, by_label: bool = False) -> DataFrame:
        """(bins, label, _weight, _n): the rows of each combination of bins (and class; ``by_label``: and label) added up.

        Trees see bins alone, and the sums of weights, labels and squares that a split's gain needs:
        the squares around a cell's mean are the same on both sides of every split, so its mean does.
        """
        bad = F.lit(math.nan)  # is refused by the fit, like such a label or weight of a row
        w = F.lit(1.0) if not self.params.get("weight_col") else F.col(self.params["weight_col"]).cast("double")
        w = F.when(w >= 0, w).otherwise(bad)
        data = data.withColumns({b: F.col(b).cast("int") for b in bins})  # drops the mark of a category: bins have an order
        if self.task == "classification":
            return data.groupBy(*bins, label_col).agg(F.sum(w).alias("_weight"), F.count(F.lit(1)).alias("_n"))
        y = F.coalesce(F.col(label_col).cast("double"), bad)
        if by_label:
            return data.groupBy(*bins, y.alias(label_col)).agg(F.sum(w).alias("_weight"), F.count(F.lit(1)).alias("_n"))
        mean = F.coalesce(F.try_divide(F.sum(w * y), F.sum(w)), F.avg(y))
        return data.groupBy(*bins).agg(mean.alias(label_col), F.sum(w).alias("_weight"), F.count(F.lit(1)).alias("_n"))

    def _prep(self, df: DataFrame) -> DataFrame:
        if self.kind == "svm":
            return self.scaler_.transform(df).select("*", *self.extra_cols_)
        return df

    def transform(self, df: DataFrame, out: str = "y_pred") -> DataFrame:
        """Adds ``out`` (original label values for classification) and, when available, ``proba``."""
        if self.model_ is None:
            raise ValueError("Model has not been trained")
        several = self.kind == "svm" and self.task == "classification"
        res = self._named(self._classified(df) if several else self.model_.transform(self._prep(df)), out)
        keep = [c for c in df.columns] + [out] + (["proba"] if "proba" in res.columns else [])
        return res.select(*[c for c in keep if c in res.columns])

    def _classified(self, df: DataFrame) -> DataFrame:
        """What the machines say, as their stage would, without a column for each component."""
        ship_package(df.sparkSession)
        made = self.model_.stages[-1].models
        W, b = rff_weights(len(self.features_), len(self.extra_cols_), seed=self.seed)
        w, c = np.array([m.coefficients.toArray() for m in made]), np.array([m.intercept for m in made])
        return self.scaler_.transform(df).withColumn("prediction", machines.classified([F.col(f) for f in self.features_], W, b, w, c))

    def _named(self, res: DataFrame, out: str) -> DataFrame:
        """What the fitted stages say, as label values and an array of probabilities."""
        if self.task == "classification":
            lab = F.array(*[F.lit(x) for x in self.labels_])
            res = res.withColumn(out, F.get(lab, F.col("prediction").cast("int")).cast(self.label_type_))
            if "probability" in res.columns:
                res = res.withColumn("proba", vector_to_array("probability"))
            return res
        return res.withColumn(out, F.col("prediction"))

    def answers(self, session: SparkSession, rows: int, out: str = "y_pred") -> "Answers | None":
        """The answers to every combination of bins, for ``rows`` rows to look up; None for a model that sees more than
        bins, and where there are more combinations than rows or than GRID."""
        if not (isinstance(self.model_, PipelineModel) and isinstance(cut := self.model_.stages[0], Bucketizer)):
            return None
        widths = [len(s) - 1 for s in cut.getSplitsArray()]
        if (n := math.prod(widths)) > min(GRID, rows):
            return None
        steps = [math.prod(widths[:i]) for i in range(len(widths))]
        grid = session.range(0, n, 1, session.sparkContext.defaultParallelism)
        grid = grid.select(F.col("id").alias("_cell"), *[_digit("id", s, w).cast("double").alias(b) for b, s, w in zip(cut.getOutputCols(), steps, widths, strict=True)])
        res = self._named(PipelineModel(self.model_.stages[1:]).transform(grid), out)
        table = written(res.select("_cell", *[c for c in (out, "proba") if c in res.columns]), "answers")
        return Answers(cut, dict(zip(self.features_, zip(steps, widths, strict=True), strict=True)), table)

    def save(self, path: str) -> None:
        """Writes the fitted model with its labels, scaler, columns and parameters (replaces ``path``)."""
        from vitalis.sources.sinks import save_model

        if self.model_ is None:
            raise ValueError("nothing to save before fit")
        scaler = None if self.scaler_ is None else {"columns": list(self.scaler_.columns), "method": self.scaler_.method, "params": self.scaler_.params_}
        save_model(self.model_, path, {"kind": type(self.kind).__name__ if isinstance(self.kind, Estimator) else self.kind, "task": self.task, "params": self.params, "seed": self.seed,
                                       "features": self.features_, "label": self.label_, "labels": self.labels_, "scaler": scaler, "label_type": self.label_type_})

    @classmethod
    def load(cls, path: str) -> "TabularModel":
        """The model that ``save`` wrote."""
        from vitalis.sources.sinks import load_model, path_exists

        model, meta = load_model(path, forest.DeepForest if path_exists(_active(), f"{path}/model/forest") else None)
        out = cls(meta["kind"], meta["task"], meta["params"], meta["seed"], meta["features"], meta["label"], model, meta["labels"])
        out.label_type_ = meta.get("label_type", "string")
        if meta["scaler"]:
            s = meta["scaler"]
            out.scaler_ = Scaler(s["columns"], s["method"], {c: tuple(v) for c, v in s["params"].items()})
            out.extra_cols_ = rff_columns(out.features_, out.params.get("n_components", 100), seed=out.seed)
        return out

    def predict_proba(self, df: DataFrame) -> DataFrame:
        if self.task == "regression":
            raise ValueError("predict_proba is only available for classification")
        return self.transform(df)

    def evaluate(self, df: DataFrame) -> DataFrame:
        pred = self.transform(df)
        if self.task == "regression":
            return M.regression_metrics(pred, self.label_, "y_pred")
        return M.classification_metrics(pred.withColumn("_y", F.col(self.label_).cast("string")).withColumn("y_pred", F.col("y_pred").cast("string")), "_y", "y_pred")

    def importances(self) -> DataFrame:
        """(feature, importance) from impurity importances (tree models), sums to 1."""
        est = self.model_.stages[-1]
        if not hasattr(est, "featureImportances"):
            raise ValueError(f"{self.kind} has no impurity importances")
        imp = est.featureImportances.toArray().tolist()
        return _active().createDataFrame(list(zip(self.features_, [float(x) for x in imp])), "feature string, importance double")


def _digit(number: str, step: int, width: int) -> Column:
    """A feature's bin in the number of a combination."""
    return F.expr(f"`{number}` div {step} % {width}")


@dataclass
class Answers:
    """``table`` (_cell, answers): what a model says to every combination of bins.  A feature's bin is a digit of the
    combination's number ``_cell``; ``digits`` are its step and width by feature."""

    cut: Bucketizer
    digits: dict[str, tuple[int, int]]
    table: DataFrame

    def cell(self, df: DataFrame) -> DataFrame:
        """Adds the number of each row's combination."""
        bins = self.cut.getOutputCols()
        number = sum((F.col(b).cast("long") * F.lit(s) for b, (s, _) in zip(bins, self.digits.values(), strict=True)), F.lit(0).cast("long"))
        number = F.coalesce(number, F.raise_error(F.lit("features with nulls, impute them first")).cast("long"))
        return self.cut.transform(df).withColumn("_cell", number).drop(*bins)

    def moved(self, feature: str, other: Column) -> Column:
        """The number of a row's combination with the bin of ``feature`` that another one has."""
        s, w = self.digits[feature]
        return F.col("_cell") + F.lit(s) * (F.floor(other / F.lit(s)) % w - _digit("_cell", s, w))

    def look_up(self, df: DataFrame) -> DataFrame:
        """Adds the answers to rows with a number; at most GRID rows are sent."""
        return df.join(F.broadcast(self.table), "_cell")

    def transform(self, df: DataFrame) -> DataFrame:
        return self.look_up(self.cell(df)).select(*df.columns, *[c for c in self.table.columns if c != "_cell"])


def _active():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()


def select_features(importances: DataFrame, threshold: str | float = "mean") -> list[str]:
    """Names with importance >= threshold ('mean', 'median' or a number), fitted on training rows."""
    if threshold == "mean":
        t = importances.agg(F.avg("importance")).first()[0]
    elif threshold == "median":
        t = importances.agg(F.percentile("importance", 0.5)).first()[0]
    else:
        t = float(threshold)
    return [r["feature"] for r in importances.where(F.col("importance") >= F.lit(t)).orderBy("feature").collect()]


# ------------------------------------------------------------------ K7 scaled pipeline

@dataclass
class ScaledModel:
    """Exact scaler (population std) followed by a model: the reference's scaler + estimator pipeline."""

    kind: str = "rf"
    scaling: str = "standard"
    task: str | None = None
    params: dict = field(default_factory=dict)
    scaler_: Scaler | None = None
    model_: TabularModel | None = None

    def fit(self, df: DataFrame, features: Sequence[str], label: str) -> "ScaledModel":
        self.scaler_ = Scaler(list(features), self.scaling).fit(df)
        self.model_ = TabularModel(self.kind, self.task, self.params).fit(self.scaler_.transform(df), features, label)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model_.transform(self.scaler_.transform(df))


# ------------------------------------------------------------------ K10 permutation importance

def permutation_importance(model: TabularModel, df: DataFrame, row_id: str, n_repeats: int = 10, seed: int = 42,
                           metric: str | None = None) -> DataFrame:
    """(feature, importance_mean, importance_std) = drop of r2 / accuracy when one feature is permuted.

    For repeat r the rows are ordered by md5(seed, r, row_id); every row takes
    the feature values of the next row in that order (a cyclic shift of a
    random order, i.e. a permutation).  All features and repeats are scored over
    an exploded frame: in one transform, or, where trees see bins alone, by
    looking up the answer to the combination of bins.
    """
    feats = model.features_
    label = model.label_
    metric = metric or ("r2" if model.task == "regression" else "accuracy")
    base = written(df.select(row_id, label, *feats), "rows")
    n = base.count()
    known = model.answers(df.sparkSession, n * n_repeats * len(feats))
    base_score = _score((known or model).transform(base), label, metric, []).first()["score"]
    cols = ["_cell"] if known else feats
    j = _with_next(known.cell(base) if known else base, row_id, [label], cols, n, n_repeats, seed)
    if known:
        cells = [F.struct(F.lit(f).alias("_feature"), known.moved(f, F.col("_next._cell")).alias("_cell")) for f in feats]
        pred = known.look_up(j.select(label, "_rep", F.inline(F.array(*cells))))
    else:
        e = j.withColumn("_feature", F.explode(F.array(*[F.lit(f) for f in feats])))
        pred = model.transform(e.withColumns({f: F.when(F.col("_feature") == f, F.col("_next").getField(f)).otherwise(F.col(f)) for f in feats}).drop("_next"))
    scores = _score(pred, label, metric, ["_feature", "_rep"])
    drops = scores.withColumn("drop", F.lit(base_score) - F.col("score"))
    return written(drops.groupBy(F.col("_feature").alias("feature")).agg(
        F.avg("drop").alias("importance_mean"), F.stddev_pop("drop").alias("importance_std")), "importances")


def _with_next(base: DataFrame, row_id: str, keep: Sequence[str], cols: Sequence[str], n: int, n_repeats: int, seed: int) -> DataFrame:
    """(keep, cols, _rep, _next): each of the ``n`` rows with the ``cols`` of the next one (the last: of the first) in the
    order of md5(seed, _rep, row_id).

    The order is cut into stretches of equal length of that number, each put in order by itself; their
    ends, one row for some STRETCH, then meet the beginning of the next.
    """
    stretches = max(1, n // STRETCH)
    reps = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_repeats - 1))).alias("_rep")).withColumn("_u", md5_unit(seed, F.col("_rep"), F.col(row_id)))
    reps = reps.withColumn("_at", F.floor(F.col("_u") * stretches))
    w = Window.partitionBy("_rep", "_at").orderBy("_u", row_id)
    taken = F.struct(*cols)
    order = reps.select(*dict.fromkeys([*keep, *cols]), "_rep", "_at", F.lead(taken).over(w).alias("_next"), F.first(taken).over(w).alias("_first"))
    order = written(order.withColumn("_first", F.when(F.col("_next").isNull(), F.col("_first"))), "order")
    ring = Window.partitionBy("_rep").orderBy("_at")
    begin = F.first("_first").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ends = order.where(F.col("_next").isNull()).withColumn("_next", F.coalesce(F.lead("_first").over(ring), begin))
    return order.where(F.col("_next").isNotNull()).unionByName(ends).drop("_first", "_at")


def _score(pred: DataFrame, label: str, metric: str, keys: list[str]) -> DataFrame:
    if metric == "r2":
        m = M.regression_metrics(pred, label, "y_pred", metrics=("r2",), by=keys or None)
        return m.withColumnRenamed("r2", "score")
    hit = (F.col(label).cast("string") == F.col("y_pred").cast("string")).cast("double")
    g = pred.groupBy(*keys) if keys else pred.groupBy()
    return g.agg(F.avg(hit).alias("score"))


# ------------------------------------------------------------------ K11 / K12 / K13 cross-validation

def fold_once(df: DataFrame, label: str, k: int, task: str, row_id: str = "row_id", time_order: str | None = None) -> DataFrame:
    """``df`` with its folds, written to the shared checkpoint folder: read by every fit, cached by none."""
    if time_order:
        from vitalis.operators.split import timeseries_split

        folded = timeseries_split(df, [time_order, row_id], k)
    else:
        folded = stratified_kfold(df, row_id, label, k) if task == "classification" else kfold(df, row_id, k)
    return written(folded, "folds")


#: Fits that are submitted at once; Spark shares the cluster among their jobs.
PARALLEL = 4
#: What the source's command line searches, by kind of model.
GRIDS = {
    "rf": {"n_estimators": [50, 100, 200], "max_depth": [None, 10, 20, 30], "min_samples_split": [2, 5, 10]},
    "gb": {"n_estimators": [50, 100, 200], "learning_rate": [0.01, 0.1, 0.2], "max_depth": [3, 5, 7]},
}
#: A metric's name, or a function of the predictions (with y_pred) that gives a number, larger for better.
Metric = str | Callable[[DataFrame], float]


def side_by_side(tasks: Sequence[Callable], parallel: int = PARALLEL) -> list:
    """Results of the tasks in order, at most ``parallel`` of them running at once; the first error is raised."""
    if parallel <= 1 or len(tasks) <= 1:
        return [t() for t in tasks]
    session = _active()
    pool = ThreadPool(min(parallel, len(tasks)))
    try:
        return pool.map(lambda t: (inheritable_thread_target(session)(t) if session else t)(), tasks, chunksize=1)
    finally:
        pool.close()


def _fold_parts(folded: DataFrame, i: int, time_order: str | None, fraction: float, row_id: str) -> tuple[DataFrame, DataFrame]:
    """Training and test rows of a fold."""
    if time_order:
        train = folded.where((F.col("fold") == i) & (F.col("role") == "train"))
        test = folded.where((F.col("fold") == i) & (F.col("role") == "test"))
    else:
        train, test = folded.where(F.col("fold") != i), folded.where(F.col("fold") == i)
    return (train.where(md5_unit(7, row_id) < fraction) if fraction < 1.0 else train), test


def _scores(model: TabularModel | Answers, frame: DataFrame, label: str, task: str, metrics: Sequence[Metric]) -> dict[str, float | None]:
    pred = model.transform(frame)
    names = [m for m in metrics if isinstance(m, str)]
    out = _metric_row(pred, label, task, names) if names else {}
    out |= {m.__name__: m(pred) for m in metrics if not isinstance(m, str)}
    return {k: None if v is None else float(v) for k, v in out.items()}


def cross_validate(df: DataFrame, features: Sequence[str], label: str, kind: str | Estimator = "rf", k: int = 5,
                   metrics: Sequence[Metric] = ("r2",), task: str | None = None, row_id: str = "row_id",
                   return_train: bool = False, params: dict | None = None, time_order: str | None = None,
                   fraction: float = 1.0, folded: DataFrame | None = None, parallel: int = PARALLEL) -> DataFrame:
    """Per-fold scores (fold, metric, part, score) for k folds (KFold / StratifiedKFold / time series).

    Each fold fits one model on the other folds (``fraction`` keeps a nested hash sample
    of them, for learning curves); folds are fitted side by side, each from the table of
    all folds, and trees that see bins alone are scored by their answers to every
    combination of bins.  ``folded`` is what ``fold_once`` returns; searches and learning
    curves pass the same one throughout.
    """
    if folded is None:
        if isinstance(kind, str) and all(isinstance(m, str) for m in metrics):  # a function may read any column
            df = df.select(*dict.fromkeys([row_id, label, *features, *filter(None, [time_order, (params or {}).get("weight_col")])]))
        df = written(df, "rows")
    task = task or infer_task(df, label)
    folded = fold_once(df, label, k, task, row_id, time_order) if folded is None else folded
    rows = folded.count() // (1 if return_train else k)

    def fold(i: int) -> list[tuple]:
        train, test = _fold_parts(folded, i, time_order, fraction, row_id)
        m = TabularModel(kind, task, dict(params or {})).fit(train, features, label, stored=True)
        m = m.answers(df.sparkSession, rows) or m
        parts = [("test", test), *[("train", train)] * return_train]
        return [(i, name, part, v) for part, frame in parts for name, v in _scores(m, frame, label, task, metrics).items()]

    rows = [r for rows in side_by_side([lambda i=i: fold(i) for i in range(k)], parallel) for r in rows]
    return df.sparkSession.createDataFrame(rows, "fold int, metric string, part string, score double")


def _metric_row(pred: DataFrame, label: str, task: str, metrics: Sequence[str]) -> dict:
    if task == "regression":
        names = [m for m in metrics if m in M.REG_METRICS]
        row = M.regression_metrics(pred, label, "y_pred", metrics=names).first()
        return {m: row[m] for m in names}
    r = M.classification_metrics(pred.withColumn("_y", F.col(label).cast("string")).withColumn("y_pred", F.col("y_pred").cast("string")), "_y", "y_pred").first().asDict()
    return {m: r[m] for m in metrics if m in r}


def cv_summary(scores: DataFrame) -> DataFrame:
    """mean and population std of each (metric, part) over folds."""
    return scores.groupBy("metric", "part").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))


def combinations_of(grid: dict, n_iter: int | None = None, seed: int = 42) -> list[dict]:
    """All combinations of a grid, or ``n_iter`` of them picked by hash."""
    import hashlib
    import itertools

    keys = sorted(grid)
    out = [dict(zip(keys, v, strict=True)) for v in itertools.product(*[grid[k] for k in keys])]
    if n_iter is not None and n_iter < len(out):
        out = sorted(out, key=lambda c: hashlib.md5(f"{seed}|{sorted(c.items())}".encode()).hexdigest())[:n_iter]
    return out


def _staged(model: TabularModel, test: DataFrame, label: str, sizes: Sequence[int]) -> dict[int, float]:
    """r2 of a boosted regression after each of some numbers of rounds: a shorter run is the beginning of a longer one."""
    frame = PipelineModel(model.model_.stages[:-1]).transform(test).withColumn(label, F.col(label).cast("double"))
    frame = frame.withColumn("_weight", F.col(w) if (w := model.params.get("weight_col")) else F.lit(1.0))
    errors = model.model_.stages[-1].evaluateEachIteration(frame, "squared")
    spread = test.agg(F.var_pop(F.col(label).cast("double"))).first()[0]
    return {n: 1 - errors[n - 1] / spread if spread else float(errors[n - 1] == 0) for n in sizes}


@dataclass
class SearchResult:
    """``results`` (params, mean_score, std_score), the ``best`` combination and ``model``, refitted with it on all rows."""

    results: DataFrame
    best: dict
    model: TabularModel | None = None


def search(df: DataFrame, features: Sequence[str], label: str, kind: str | Estimator, grid: dict, k: int = 5,
           metric: Metric | None = None, task: str | None = None, row_id: str = "row_id", n_iter: int | None = None,
           seed: int = 42, parallel: int = PARALLEL, refit: bool = True) -> SearchResult:
    """Grid search (random: ``n_iter`` combinations) with k-fold scores; larger scores are better, ties go to the first.

    Folds are made once as a table.  Every (combination, fold) is a fit of its own, at most
    ``parallel`` of them at once.  Boosted regressions scored by r2 that differ in their
    number of rounds alone are one fit, read off after each number.
    """
    task = task or infer_task(df, label)
    metric = metric or ("r2" if task == "regression" else "accuracy")
    combos = combinations_of(grid, n_iter, seed)
    folded = fold_once(df, label, k, task, row_id)
    staged = kind == "gb" and task == "regression" and metric == "r2"
    families: dict[tuple, list[int]] = {}
    for n, c in enumerate(combos):
        families.setdefault(tuple(sorted((x, str(v)) for x, v in c.items() if x != "n_estimators")) if staged else (n,), []).append(n)

    def unit(members: list[int], i: int) -> list[tuple[int, float | None]]:
        train, test = _fold_parts(folded, i, None, 1.0, row_id)
        longest = max((combos[n] for n in members), key=lambda c: c.get("n_estimators", 0))
        m = TabularModel(kind, task, dict(longest), seed).fit(train, features, label)
        if len(members) > 1:
            r2 = _staged(m, test, label, [combos[n]["n_estimators"] for n in members])
            return [(n, r2[combos[n]["n_estimators"]]) for n in members]
        return [(members[0], next(iter(_scores(m, test, label, task, (metric,)).values())))]

    tasks = [lambda m=m, i=i: unit(m, i) for m in families.values() for i in range(k)]
    scores: list[list[float]] = [[] for _ in combos]
    for n, v in (x for got in side_by_side(tasks, parallel) for x in got):
        scores[n].append(float("nan") if v is None else v)
    rows = [(str(sorted(c.items())), float(np.mean(v)), float(np.std(v))) for c, v in zip(combos, scores, strict=True)]
    best = combos[max(range(len(rows)), key=lambda n: (-math.inf if math.isnan(rows[n][1]) else rows[n][1], -n))]
    model = TabularModel(kind, task, dict(best), seed).fit(df, features, label) if refit else None
    return SearchResult(df.sparkSession.createDataFrame(rows, "params string, mean_score double, std_score double"), best, model)


def grid_search(df: DataFrame, features: Sequence[str], label: str, kind: str | Estimator, grid: dict, k: int = 5,
                metric: Metric | None = None, task: str | None = None, row_id: str = "row_id", n_iter: int | None = None,
                seed: int = 42, parallel: int = PARALLEL) -> tuple[DataFrame, dict]:
    """(results, best parameters) of ``search`` without the refit."""
    r = search(df, features, label, kind, grid, k, metric, task, row_id, n_iter, seed, parallel, refit=False)
    return r.results, r.best


def random_search(df: DataFrame, features: Sequence[str], label: str, kind: str | Estimator, grid: dict, n_iter: int = 10, **options) -> SearchResult:
    """``search`` over ``n_iter`` combinations picked by hash."""
    return search(df, features, label, kind, grid, n_iter=n_iter, **options)


def _moments(parts: Sequence[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, means and population covariance of the rows of all parts (each with its own)."""
    n = sum(p[0] for p in parts)
    mean = sum(p[0] * p[1] for p in parts) / n
    return n, mean, sum(p[0] * (p[2] + np.outer(p[1] - mean, p[1] - mean)) for p in parts) / n


def _points(mean: np.ndarray, cov: np.ndarray) -> np.ndarray | None:
    """A few points that have these means and covariances; None if they are nearly singular."""
    std = np.sqrt(np.diag(cov))
    if not (np.isfinite(cov).all() and (std > 1e-9 * np.abs(mean)).all()):
        return None
    vals, vecs = np.linalg.eigh(cov / np.outer(std, std))
    if vals[0] < 1e-12 or np.linalg.eigvalsh((cov / np.outer(std, std))[:-1, :-1])[0] < 1e-9:
        return None
    m = len(mean) + 1
    corners = np.linalg.qr(np.column_stack([np.ones(m), np.eye(m)[:, : m - 1]]))[0][:, 1:]  # orthonormal, of sum 0
    return mean + math.sqrt(m) * (corners @ (np.sqrt(vals)[:, None] * vecs.T)) * std


def _linear_curve(folded: DataFrame, features: Sequence[str], label: str, k: int, fractions: Sequence[float], row_id: str, parallel: int) -> list[tuple] | None:
    """Rows (fold, 'r2', part, score, fraction) of a learning curve of least squares from two passes over all rows.

    A least-squares fit hangs on the means and covariances of its rows alone.  One pass adds
    them up by fold and band (the smallest fraction that a row is in), which make up those of
    every training set; each model is fitted on a few points that have them.  One
    more pass adds up the squared errors of all models by fold and band.  None where this
    doesn't hold: other values than finite numbers, parts without rows, (nearly) dependent columns.
    """
    spark, feats = folded.sparkSession, list(features)
    steps = sorted({float(f) for f in fractions})
    u = md5_unit(7, row_id)
    band = F.lit(len(steps))
    for b, f in reversed(list(enumerate(steps))):
        band = F.when(u < f, F.lit(b)).otherwise(band) if f < 1.0 else F.lit(b)
    if not all(isinstance(folded.schema[c].dataType, NumericType) for c in [*feats, label]):
        return None
    cols = [f"_x{i}" for i in range(len(feats) + 1)]
    d = folded.select("fold", band.alias("_band"), *[F.col(c).cast("double").alias(x) for c, x in zip([*feats, label], cols, strict=True)])
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1)]
    bad = F.lit(False)
    for c in cols:
        bad = bad | F.col(c).isNull() | ~(F.abs(c) < math.inf)
    sums = d.groupBy("fold", "_band").agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                                          *[F.covar_pop(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs]).collect()  # folds x bands
    if any(r["bad"] for r in sums):
        return None
    parts: dict[tuple[int, int], tuple[int, np.ndarray, np.ndarray]] = {}
    for r in sums:
        cov = np.zeros((len(cols), len(cols)))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = r[f"c{i}_{j}"]
        parts[r["fold"], r["_band"]] = r["n"], np.array([r[f"m{i}"] for i in range(len(cols))]), cov
    units = [(f, b, i) for b, f in enumerate(steps) for i in range(k)]
    fits, rests = [], []
    for f, b, i in units:
        train = [x for (fold, at), x in parts.items() if fold != i and at <= b]
        test = [x for (fold, _), x in parts.items() if fold == i]
        if not train or not test or sum(x[0] for x in test) < 2:
            return None
        n, mean, cov = _moments(train)
        points = _points(mean, cov) if n > len(cols) else None
        if points is None:
            return None
        fits.append(spark.createDataFrame([tuple(map(float, p)) for p in points], ", ".join(f"{c} double" for c in cols)))
    for m in side_by_side([lambda x=x: TabularModel("linear", "regression").fit(x, cols[:-1], cols[-1]).model_.stages[-1] for x in fits], parallel):
        y = F.lit(float(m.intercept))
        for c, x in zip(m.coefficients.toArray().tolist(), cols, strict=False):
            y = y + F.lit(c) * F.col(x)
        rests.append(F.col(cols[-1]) - y)
    errors = {(r["fold"], r["_band"]): r for r in d.groupBy("fold", "_band").agg(*[F.sum(e * e).alias(f"e{m}") for m, e in enumerate(rests)]).collect()}
    out = []
    for m, (f, b, i) in enumerate(units):
        for part, keys in (("test", [x for x in parts if x[0] == i]), ("train", [x for x in parts if x[0] != i and x[1] <= b])):
            n, _, cov = _moments([parts[x] for x in keys])
            if not cov[-1, -1] > 0:
                return None
            out.append((i, "r2", part, float(1 - sum(errors[x][f"e{m}"] for x in keys) / (n * cov[-1, -1])), f))
    return out


def learning_curve(df: DataFrame, features: Sequence[str], label: str, kind: str | Estimator = "rf", k: int = 5,
                   fractions: Sequence[float] = (0.1, 0.325, 0.55, 0.775, 1.0), metric: Metric | None = None,
                   task: str | None = None, row_id: str = "row_id", parallel: int = PARALLEL) -> DataFrame:
    """(metric, part, mean, std, fraction) of train and test scores over nested hash samples of the training folds."""
    task = task or infer_task(df, label)
    metric = metric or ("r2" if task == "regression" else "accuracy")
    if isinstance(metric, str):  # a function may read any column
        df = df.select(*dict.fromkeys([row_id, label, *features]))
    folded = fold_once(df, label, k, task, row_id)
    rows = _linear_curve(folded, features, label, k, fractions, row_id, parallel) if (kind, task, metric) == ("linear", "regression", "r2") else None
    if rows is not None:
        return _curve(df.sparkSession, rows)

    def unit(fraction: float, i: int) -> list[tuple]:
        train, test = _fold_parts(folded, i, None, fraction, row_id)
        m = TabularModel(kind, task).fit(train, features, label)
        return [(i, name, part, v, fraction) for part, frame in (("test", test), ("train", train)) for name, v in _scores(m, frame, label, task, (metric,)).items()]

    rows = [r for got in side_by_side([lambda f=f, i=i: unit(float(f), i) for f in fractions for i in range(k)], parallel) for r in got]
    return _curve(df.sparkSession, rows)


def _curve(spark, rows: list[tuple]) -> DataFrame:
    s = spark.createDataFrame(rows, "fold int, metric string, part string, score double, fraction double")
    return s.groupBy("metric", "part", "fraction").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std")).select("metric", "part", "mean", "std", "fraction")


# ------------------------------------------------------------------ K14 ordinal, K15 ensemble, K16 stacking

@dataclass
class OrdinalClassifier:
    """K-1 class-weighted logistic models of P(y > k); class = number of thresholds passed (>= 0.5)."""

    classes: Sequence
    alpha: float = 0.1
    models_: list = field(default_factory=list)

    def fit(self, df: DataFrame, features: Sequence[str], label: str) -> "OrdinalClassifier":
        idx = F.create_map(*[x for i, c in enumerate(self.classes) for x in (F.lit(c), F.lit(i))])
        base = df.withColumn("_ord", idx[F.col(label)])
        self.models_ = []
        for k in range(len(self.classes) - 1):
            y = (F.col("_ord") > k).cast("double")
            d = base.withColumn("_yk", y)
            counts = {r["_yk"]: r["n"] for r in d.groupBy("_yk").agg(F.count(F.lit(1)).alias("n")).collect()}
            n, n_cls = sum(counts.values()), len(counts)
            w = F.create_map(*[x for c, cnt in counts.items() for x in (F.lit(c), F.lit(n / (n_cls * cnt)))])
            d = d.withColumn("_w", w[F.col("_yk")])
            sum_w = float(n)
            reg = 1.0 / ((1.0 / self.alpha) * sum_w)  # C = 1/alpha on a weight sum of n
            m = TabularModel("logistic", "classification", {"reg": reg, "weight_col": "_w"}).fit(d, features, "_yk")
            self.models_.append(m)
        return self

    def threshold_probs(self, df: DataFrame) -> DataFrame:
        out = df
        for k, m in enumerate(self.models_):
            p = m.transform(out, out=f"_yp{k}")
            pos = F.array_position(F.array(*[F.lit(x) for x in m.labels_]), F.lit("1.0")) - 1
            out = p.withColumn(f"p_gt_{k}", F.get(F.col("proba"), pos.cast("int"))).drop("proba", f"_yp{k}")
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        probs = self.threshold_probs(df)
        return ordinal_combine(probs, [f"p_gt_{k}" for k in range(len(self.models_))], self.classes)


def ordinal_combine(df: DataFrame, thr_cols: Sequence[str], classes: Sequence, threshold: float = 0.5) -> DataFrame:
    """Class = count of P(y>k) >= threshold (capped); class probabilities by differences."""
    passes = sum((F.col(c) >= threshold).cast("int") for c in thr_cols)
    lab = F.array(*[F.lit(c) for c in classes])
    K = len(classes)
    probs = [1 - F.col(thr_cols[0])] + [F.col(thr_cols[k - 1]) - F.col(thr_cols[k]) for k in range(1, K - 1)] + \
            [F.col(thr_cols[-1])]
    return df.withColumn("y_pred", F.get(lab, F.least(passes, F.lit(K - 1)))).withColumn("class_proba", F.array(*probs))


def ensemble_combine(df: DataFrame, pred_cols: Sequence[str], weights: Sequence[float] | None = None,
                     regression: bool = True, proba_cols: Sequence[str] | None = None,
                     classes: Sequence | None = None) -> DataFrame:
    """Weighted mean (regression), weighted mean probability -> arg-max label, or weighted majority vote."""
    n = len(pred_cols)
    weights = list(weights) if weights is not None else [1.0] * n
    if len(weights) != n:
        raise ValueError("number of weights must match number of models")
    tot = sum(weights)
    w = [x / tot for x in weights]
    if regression:
        return df.withColumn("y_pred", sum(F.col(c) * F.lit(wi) for c, wi in zip(pred_cols, w)))
    if proba_cols:
        k = len(classes)
        mean = F.array(*[sum(F.get(F.col(pc), j) * F.lit(wi) for pc, wi in zip(proba_cols, w)) for j in range(k)])
        lab = F.array(*[F.lit(c) for c in classes])
        pos = F.array_position(mean, F.array_max(mean)) - 1
        return df.withColumn("ensemble_proba", mean).withColumn("y_pred", F.get(lab, pos.cast("int")))
    votes = F.array(*[F.struct(F.col(c).cast("string").alias("v"), F.lit(wi).alias("w")) for c, wi in zip(pred_cols, w)])
    score = lambda cand: F.aggregate(votes, F.lit(0.0), lambda a, s: a + F.when(s["v"] == cand, s["w"]).otherwise(0.0))
    best = F.aggregate(votes, F.struct(F.lit(-1.0).alias("s"), F.lit(None).cast("string").alias("v")),
                       lambda acc, s: F.when((score(s["v"]) > acc["s"]) | ((score(s["v"]) == acc["s"]) & (s["v"] < acc["v"])),
                                             F.struct(score(s["v"]).alias("s"), s["v"].alias("v"))).otherwise(acc))
    return df.withColumn("y_pred", best["v"])


@dataclass
class Ensemble:
    kinds: Sequence[str] = ("rf", "gb", "elastic")
    weights: Sequence[float] | None = None
    task: str | None = None
    models_: list = field(default_factory=list)

    def fit(self, df: DataFrame, features: Sequence[str], label: str) -> "Ensemble":
        self.task = self.task or infer_task(df, label)
        self.models_ = [TabularModel(k, self.task).fit(df, features, label) for k in self.kinds]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        cur = df
        pcols, prob_cols = [], []
        for i, m in enumerate(self.models_):
            cur = m.transform(cur, out=f"_p{i}")
            if "proba" in cur.columns:
                cur = cur.withColumnRenamed("proba", f"_proba{i}")
                prob_cols.append(f"_proba{i}")
            pcols.append(f"_p{i}")
        reg = self.task == "regression"
        use_proba = (not reg) and len(prob_cols) == len(pcols)
        return ensemble_combine(cur, pcols, self.weights, reg, prob_cols if use_proba else None,
                                self.models_[0].labels_ if not reg else None)


@dataclass
class Stacking:
    """Out-of-fold base predictions (k folds) -> meta model; bases refit on all rows."""

    base_kinds: Sequence[str] = ("rf", "elastic")
    meta_kind: str = "rf"
    k: int = 5
    task: str | None = None
    bases_: list = field(default_factory=list)
    meta_: TabularModel | None = None
    meta_cols_: list = field(default_factory=list)

    def _meta_features(self, pred: DataFrame, i: int, m: TabularModel) -> tuple[DataFrame, list[str]]:
        if self.task == "regression":
            return pred.withColumnRenamed("_yp", f"_m{i}"), [f"_m{i}"]
        cols = [f"_m{i}_{j}" for j in range(len(m.labels_))]
        out = pred
        for j, c in enumerate(cols):
            out = out.withColumn(c, F.get(F.col("proba"), j))
        return out.drop("proba", "_yp"), cols

    def fit(self, df: DataFrame, features: Sequence[str], label: str, row_id: str = "row_id") -> "Stacking":
        self.task = self.task or infer_task(df, label)
        folded = (kfold(df, row_id, self.k) if self.task == "regression"
                  else stratified_kfold(df, row_id, label, self.k)).persist(StorageLevel.MEMORY_AND_DISK)
        oof = None
        for i in range(self.k):
            tr, te = folded.where(F.col("fold") != i), folded.where(F.col("fold") == i)
            cur = te.select(row_id, label, *features)
            meta_cols = []
            for b, kind in enumerate(self.base_kinds):
                m = TabularModel(kind, self.task).fit(tr, features, label)
                cur, cols = self._meta_features(m.transform(cur, out="_yp"), b, m)
                meta_cols += cols
            oof = cur if oof is None else oof.unionByName(cur)
        self.meta_cols_ = meta_cols
        self.meta_ = TabularModel(self.meta_kind, self.task).fit(oof, meta_cols, label)
        self.bases_ = [TabularModel(kind, self.task).fit(df, features, label) for kind in self.base_kinds]
        folded.unpersist()
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        cur = df
        for b, m in enumerate(self.bases_):
            cur, _ = self._meta_features(m.transform(cur, out="_yp"), b, m)
        return self.meta_.transform(cur).drop(*self.meta_cols_)


# ------------------------------------------------------------------ K17 / K18 / K19

def covariance_matrix(df: DataFrame, features: Sequence[str]) -> np.ndarray:
    """p x p sample covariance from one pass of block products (rows complete in all features)."""
    g = gram(df.select(*features).dropna(), list(features))
    return g.covariance() * g.n / (g.n - 1)


def pca_variance(df: DataFrame, features: Sequence[str], n_components: int | None = None,
                 standardize: bool = True) -> tuple[DataFrame, dict]:
    """Explained variance ratio and cumulative ratio per component; components needed for .7/.8/.9/.95.

    The covariance (p x p) is one distributed aggregate; the eigen-decomposition of
    that small matrix runs on the driver.
    """
    C = covariance_matrix(df, features)
    if standardize:
        s = np.sqrt(np.diag(C))
        s[s == 0] = 1.0
        C = C / np.outer(s, s)
    vals = np.sort(np.linalg.eigvalsh(C))[::-1]
    vals = np.clip(vals, 0, None)
    ratio = vals / vals.sum() if vals.sum() > 0 else vals
    cum = np.cumsum(ratio)
    k = n_components or len(vals)
    rows = [(i + 1, float(ratio[i]), float(cum[i])) for i in range(k)]
    needed = {t: int(np.searchsorted(cum, t - 1e-12) + 1) for t in (0.7, 0.8, 0.9, 0.95)}
    spark = df.sparkSession
    return spark.createDataFrame(rows, "component int, variance_ratio double, cumulative double"), needed


def pca_project(df: DataFrame, features: Sequence[str], k: int = 2, standardize: bool = True,
                keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Scores on the first k components (centred, optionally standardised) and the loadings.

    Each component's sign is fixed so that its largest absolute loading is positive.
    """
    feats = list(features)
    scaler = Scaler(feats, "standard" if standardize else "none")
    if not standardize:
        means = df.agg(*[F.avg(f).alias(f) for f in feats]).first().asDict()
        scaler.params_ = {f: (means[f], 1.0) for f in feats}
    else:
        scaler.fit(df)
    z = scaler.transform(df)
    C = covariance_matrix(z, feats)
    vals, vecs = np.linalg.eigh(C)
    order = np.argsort(vals)[::-1][:k]
    V = vecs[:, order]
    for j in range(V.shape[1]):
        if V[np.argmax(np.abs(V[:, j])), j] < 0:
            V[:, j] = -V[:, j]
    comps = [sum(F.col(f) * F.lit(float(V[i, j])) for i, f in enumerate(feats)).alias(f"pc{j + 1}")
             for j in range(V.shape[1])]
    scores = z.select(*keep, *comps)
    spark = df.sparkSession
    load = spark.createDataFrame([(f, *[float(V[i, j]) for j in range(V.shape[1])]) for i, f in enumerate(feats)],
                                 "feature string, " + ", ".join(f"pc{j + 1} double" for j in range(V.shape[1])))
    return scores, load


def linkage(D: np.ndarray) -> list[tuple[int, int, float]]:
    """Average linkage of a distance matrix by nearest-neighbour chains, in O(p^2): (a, b, height) by height.

    A chain goes from cluster to nearest cluster until two are each other's nearest; they
    are merged, and distances to the union are means weighted by size.  Clusters of more
    than one leaf are numbered from p on, in the order of the merges returned.
    """
    p = len(D)
    D = D.astype(float).copy()
    np.fill_diagonal(D, np.inf)
    size, alive = np.ones(p), np.ones(p, bool)
    found: list[tuple[float, int, int]] = []  # height and a leaf of either side
    chain: list[int] = []
    for _ in range(p - 1):
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            a = chain[-1]
            b = int(np.argmin(np.where(alive, D[a], np.inf)))
            if len(chain) > 1 and D[a, chain[-2]] <= D[a, b]:
                b = chain[-2]
                break
            chain.append(b)
        del chain[-2:]
        a, b = min(a, b), max(a, b)
        found.append((float(D[a, b]), a, b))
        row = (size[a] * D[a] + size[b] * D[b]) / (size[a] + size[b])
        D[a], D[:, a] = row, row
        D[a, a] = np.inf
        size[a] += size[b]
        alive[b] = False
    own = list(range(p))

    def root(x: int) -> int:
        while own[x] != x:
            own[x] = own[own[x]]
            x = own[x]
        return x

    out, name = [], list(range(p))
    for n, (height, a, b) in enumerate(sorted(found, key=lambda m: m[0])):
        x, y = root(a), root(b)
        out.append((min(name[x], name[y]), max(name[x], name[y]), height))
        own[y] = x
        name[x] = p + n
    return out


def feature_clusters(corr_long: DataFrame) -> DataFrame:
    """Average-linkage (euclidean on correlation rows) leaf order of the features: (feature, position, merge_height).

    merge_height is where a feature first joins others.  Input is the long correlation
    matrix (col_a, col_b, r) from ``stats.corr_pearson``, p x p numbers, NULL taken as 0.
    """
    rows = corr_long.collect()
    names = sorted({r["col_a"] for r in rows})
    idx = {n: i for i, n in enumerate(names)}
    p = len(names)
    R = np.zeros((p, p))
    for r in rows:
        R[idx[r["col_a"]], idx[r["col_b"]]] = 0.0 if r["r"] is None else r["r"]
    square = (R * R).sum(1)
    D = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * R @ R.T, 0))
    clusters, height = {i: [i] for i in range(p)}, {}
    for n, (a, b, h) in enumerate(linkage(D)):
        height.update({x: h for x in (a, b) if x < p})
        clusters[p + n] = clusters.pop(a) + clusters.pop(b)
    order = next(iter(clusters.values()), [])
    return corr_long.sparkSession.createDataFrame([(names[m], pos, float(height.get(m, 0.0))) for pos, m in enumerate(order)],
                                                  "feature string, position int, merge_height double")


# ------------------------------------------------------------------ K5 ordinary least squares (SQL-checkable)

def ols(df: DataFrame, x: str, y: str) -> DataFrame:
    """Simple linear regression y ~ x: slope, intercept, r2 in one aggregate."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                  F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))
