"""Modules in order, by name, with columns by type where none are given."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from concord.operators.preprocess import encoders, imputer, scalers, transformers
from concord.operators.preprocess.base import Module, check_role
from concord.types import numeric_columns, other_columns

MODULES: dict[str, type[Module]] = {
    m.__name__: m
    for m in (
        scalers.MaxAbsScaler, scalers.MinMaxScaler, scalers.Normalizer, scalers.RobustScaler, scalers.StandardScaler, imputer.SimpleImputer,
        encoders.KBinsDiscretizer, encoders.LabelEncoder, encoders.LabelBinarizer, encoders.MultiLabelBinarizer, encoders.OneHotEncoder, encoders.OrdinalEncoder,
        encoders.TargetEncoder, transformers.PowerTransformer, transformers.QuantileTransformer, transformers.SplineTransformer,
    )
}
OF_TEXT = {"OneHotEncoder", "OrdinalEncoder", "TargetEncoder"}
OF_LABEL = {"LabelEncoder", "LabelBinarizer", "MultiLabelBinarizer"}
SKETCHED = {"RobustScaler", "KBinsDiscretizer", "QuantileTransformer", "SimpleImputer"}


def check_sketch(params: dict) -> None:
    """Names and sizes of sketches that quantile and frequency modules may be given."""
    if params.get("sketch_name", "KLL") not in ("KLL", "REQ"):
        raise ValueError("sketch_name is KLL or REQ")
    if params.get("k", 200) < 1:
        raise ValueError("k is at least 1")
    if not isinstance(params.get("is_hra", True), bool):
        raise ValueError("is_hra is true or false")
    if params.get("error_type", "NFN") not in ("NFN", "NFP"):
        raise ValueError("error_type is NFN or NFP")


class PreprocessPipeline:
    """steps: [(module name, {column or columns: ..., parameters})]; label and id are left out of default columns."""

    def __init__(self, steps: list[tuple[str, dict]], label: str | None = None, id: str | None = None, fl_type: str = "H", role: str = "client"):
        check_role(fl_type, role)
        unknown = [n for n, _ in steps if n not in MODULES]
        if unknown:
            raise ValueError(f"no such modules: {', '.join(unknown)}")
        self.steps, self.label, self.id, self.modules = steps, label, id, []

    def _columns(self, name: str, df: DataFrame) -> list[str]:
        if name in OF_LABEL:
            if not self.label:
                raise ValueError(f"{name} needs a label")
            return [self.label]
        every = other_columns(df) if name in OF_TEXT else numeric_columns(df)
        return [c for c in every if c not in (self.label, self.id)]

    def fit_transform(self, df: DataFrame) -> DataFrame:
        self.modules = []
        for name, given in self.steps:
            params = dict(given)
            columns = params.pop("columns", None) or ([params.pop("column")] if isinstance(params.get("column"), str) else params.pop("column", None)) or self._columns(name, df)
            if name in SKETCHED:
                check_sketch(params)
            if name == "TargetEncoder":
                params.setdefault("target", self.label)
            module = MODULES[name](columns, **params).fit(df)
            df = module.transform(df)
            self.modules.append(module)
        return df

    def transform(self, df: DataFrame) -> DataFrame:
        """What the fitted modules do to another frame; nothing is fitted again."""
        for m in self.modules:
            df = m.transform(df)
        return df

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump({"steps": self.steps, "label": self.label, "id": self.id, "modules": [json.loads(m.to_json()) for m in self.modules]}, f)

    @classmethod
    def load(cls, path: str) -> "PreprocessPipeline":
        with open(path) as f:
            d = json.load(f)
        out = cls([tuple(s) for s in d["steps"]], d["label"], d["id"])
        for m in d["modules"]:
            params = dict(m["params"])
            if m["module"] == "TargetEncoder":
                params["target"] = d["label"]
            module = MODULES[m["module"]](m["columns"], **params)
            module.state = m["state"]
            out.modules.append(module)
        return out
