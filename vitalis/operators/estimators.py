"""The library's fitted objects as ``pyspark.ml`` stages: in a Pipeline, saved and loaded with it.

``TableEstimator`` names an operator (a tabular, scaled, ordinal, ensemble or stacked
model, a preprocessor, or any of its steps), its options, features and label; fitting
it gives a ``TableModel`` around the fitted object.  What is saved is the object's
fields as JSON beside its Spark ML models and tables, each by its own writer.
"""

from __future__ import annotations

import dataclasses
import importlib
import json
from collections.abc import Sequence
from typing import Any

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable,
                             MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame, SparkSession

from vitalis.operators import clean, ml

#: Operators by name; those of the second group take no label.
MODELS = {"tabular": ml.TabularModel, "scaled": ml.ScaledModel, "ordinal": ml.OrdinalClassifier, "ensemble": ml.Ensemble, "stacking": ml.Stacking}
STEPS = {"preprocessor": clean.Preprocessor, "imputer": clean.Imputer, "scaler": clean.Scaler, "power": clean.PowerTransformer,
         "outliers": clean.OutlierRemover, "knn": clean.KnnImputer}


# ---- fitted objects as JSON, with models and tables in folders beside it


class _Parts:
    """Gives the models and tables of one object folders of their own."""

    def __init__(self, path: str) -> None:
        self.path, self.n = path, 0

    def next(self) -> str:
        self.n += 1
        return f"part{self.n}"


def _name(x: Any) -> str:
    name = f"{x.__module__}:{x.__qualname__}"
    if _named(name) is not x:
        raise ValueError(f"{x} can't be saved: it has no name in a module")
    return name


def _named(name: str) -> Any:
    module, path = name.split(":")
    out: Any = importlib.import_module(module)
    for x in path.split("."):
        out = getattr(out, x, None)
    return out


def packed(x: Any, parts: _Parts) -> Any:
    """JSON for a field's value."""
    if x is None or isinstance(x, (bool, int, float, str)):
        return x
    if isinstance(x, np.generic):
        return x.item()
    if isinstance(x, ml.TabularModel):
        name = parts.next()
        x.save(f"{parts.path}/{name}")
        return {"model": name}
    if isinstance(x, DataFrame):
        name = parts.next()
        x.write.mode("overwrite").parquet(f"{parts.path}/{name}")
        return {"table": name}
    if isinstance(x, np.ndarray):
        return {"array": x.tolist(), "type": str(x.dtype)}
    if dataclasses.is_dataclass(x) and not isinstance(x, type):
        return {"object": _name(type(x)), "fields": {f.name: packed(getattr(x, f.name), parts) for f in dataclasses.fields(x)}}
    if isinstance(x, dict):
        return {"dict": [[packed(k, parts), packed(v, parts)] for k, v in x.items()]}
    if isinstance(x, (list, tuple)):
        return {"tuple" if isinstance(x, tuple) else "list": [packed(v, parts) for v in x]}
    if callable(x):
        return {"function": _name(x)}
    raise ValueError(f"a {type(x).__name__} can't be saved")


def unpacked(x: Any, path: str) -> Any:
    """The value of its JSON."""
    if not isinstance(x, dict):
        return x
    if "model" in x:
        return ml.TabularModel.load(f"{path}/{x['model']}")
    if "table" in x:
        return SparkSession.getActiveSession().read.parquet(f"{path}/{x['table']}")
    if "array" in x:
        return np.array(x["array"], dtype=x["type"])
    if "object" in x:
        return _named(x["object"])(**{k: unpacked(v, path) for k, v in x["fields"].items()})
    if "dict" in x:
        return {unpacked(k, path): unpacked(v, path) for k, v in x["dict"]}
    if "function" in x:
        return _named(x["function"])
    (kind, items), = x.items()
    out = [unpacked(v, path) for v in items]
    return tuple(out) if kind == "tuple" else out


# ---- stages


class TableEstimator(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Fits the operator ``operator`` (a name of MODELS or STEPS) with JSON ``options`` on ``features`` and ``label``."""

    operator = Param(Params._dummy(), "operator", "name of the operator", typeConverter=TypeConverters.toString)
    options = Param(Params._dummy(), "options", "its options as a JSON object", typeConverter=TypeConverters.toString)
    features = Param(Params._dummy(), "features", "feature columns", typeConverter=TypeConverters.toListString)
    label = Param(Params._dummy(), "label", "label column (models)", typeConverter=TypeConverters.toString)

    def __init__(self, operator: str = "tabular", features: Sequence[str] = (), label: str = "", **options: Any) -> None:
        super().__init__()
        self._set(operator=operator, options=json.dumps(options), features=list(features), label=label)

    def _fit(self, dataset: DataFrame) -> TableModel:
        name, feats = self.getOrDefault(self.operator), self.getOrDefault(self.features)
        options = json.loads(self.getOrDefault(self.options))
        if name in MODELS:
            fitted = MODELS[name](**options).fit(dataset, feats, self.getOrDefault(self.label))
        elif name in STEPS:
            fitted = STEPS[name](feats, **options).fit(dataset)
        else:
            raise ValueError(f"unknown operator {name!r}; there are {sorted([*MODELS, *STEPS])}")
        return TableModel(fitted)


class _Writer(MLWriter):
    def __init__(self, instance: TableModel) -> None:
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:  # noqa: N802 - pyspark's name
        state = packed(self.instance.fitted, _Parts(path))
        session = self.sparkSession if hasattr(self, "sparkSession") else SparkSession.getActiveSession()
        DefaultParamsWriter.saveMetadata(self.instance, path, session, extraMetadata={"state": state})


class _Reader(MLReader):
    def __init__(self, cls: type) -> None:
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> TableModel:
        session = self.sparkSession if hasattr(self, "sparkSession") else SparkSession.getActiveSession()
        metadata = DefaultParamsReader.loadMetadata(path, session)
        out = self.cls(unpacked(metadata["state"], path))
        out._resetUid(metadata["uid"])
        return out


class TableModel(Model, MLReadable, MLWritable):
    """A fitted operator as a Spark ML model: ``fitted`` is the operator itself."""

    def __init__(self, fitted: Any = None) -> None:
        super().__init__()
        self.fitted = fitted

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.fitted.transform(dataset)

    def write(self) -> _Writer:
        return _Writer(self)

    @classmethod
    def read(cls) -> _Reader:
        return _Reader(cls)
