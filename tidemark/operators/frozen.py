"""Fitted pipelines that are frozen: saved with what they were fitted on, applied forward, never fitted again.

The manifest names the columns and their types, the last period that was fitted on, how many rows there
were and their content's digest, and what the model has learnt; a seal over all of it is checked on
loading, so neither the manifest nor the model can be changed without notice.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.manifests import content_sum
from ..sources.tapes import write_once


def _learnt(model: PipelineModel) -> str:
    """What the stages have learnt, in words: every value their parameters and fitted vectors have."""
    told = []
    for stage in model.stages:
        told.append([type(stage).__name__, sorted((p.name, str(v)) for p, v in stage.extractParamMap().items())])
        told += [[name, str(getattr(stage, name))] for name in ("coefficients", "intercept", "mean", "std", "labels") if hasattr(stage, name)]
    return hashlib.sha256(json.dumps(told).encode()).hexdigest()


def _seal(fields: dict) -> str:
    return hashlib.sha256(json.dumps(fields, sort_keys=True).encode()).hexdigest()


def freeze(model: PipelineModel, train: DataFrame, columns: list[str], period: str, path: str) -> None:
    """Save a model fitted on train's columns up to train's last period; a path is written once."""
    seen = train.agg(F.count(F.lit(1)).alias("rows"), F.max(period).cast("long").alias("until"), content_sum(*columns, period).alias("content")).first()
    fields = {"columns": {c: train.schema[c].dataType.simpleString() for c in columns}, "period": period, "until": seen["until"], "rows": seen["rows"], "content": seen["content"], "learnt": _learnt(model)}
    model.save(f"{path}/model")
    manifest = train.sparkSession.createDataFrame([(json.dumps(fields, sort_keys=True), _seal(fields))], "fields string, seal string")
    write_once(manifest, f"{path}/manifest", "json")


class Frozen:
    """A frozen pipeline, loaded."""

    def __init__(self, spark: SparkSession, path: str):
        row = spark.read.schema("fields string, seal string").json(f"{path}/manifest").first()
        self.fields = json.loads(row["fields"])
        if _seal(self.fields) != row["seal"]:
            raise ValueError(f"the manifest in {path} is not as it was sealed")
        self.model = PipelineModel.load(f"{path}/model")
        if _learnt(self.model) != self.fields["learnt"]:
            raise ValueError(f"the model in {path} is not the one of its manifest")

    def apply(self, rows: DataFrame) -> DataFrame:
        """rows with the model's columns.  ValueError: a column is missing or of another type.  A row of a period
        that was fitted on stops the query: the model is for what came after."""
        now = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
        if wrong := [c for c, kind in self.fields["columns"].items() if now.get(c) != kind]:
            raise ValueError(f"columns that are not those of the fit: {', '.join(wrong)}")
        period = F.col(self.fields["period"])
        late = F.when(period > self.fields["until"], period).otherwise(F.raise_error(F.lit("a row of the time that the model was fitted on")).cast(rows.schema[self.fields["period"]].dataType))
        return self.model.transform(rows.withColumn(self.fields["period"], late))

    def check_fit(self, train: DataFrame) -> None:
        """ValueError unless train has the very rows of the fit: no later row may be fitted on."""
        if train.where(F.col(self.fields["period"]) > self.fields["until"]).limit(1).count():
            raise ValueError("rows of the time after the fit are for acceptance")
        if train.agg(content_sum(*self.fields["columns"], self.fields["period"]).alias("content")).first()["content"] != self.fields["content"]:
            raise ValueError("these are not the rows of the fit")
