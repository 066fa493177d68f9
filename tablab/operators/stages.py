"""A trained model as one Spark ML pipeline.

:func:`export_pipeline` writes label codes, scaling, kernel features, the model and its probabilities and class names as
writable Spark ML stages.  ``PipelineModel.load(f"{path}/pipeline").transform(rows)`` then gives the model's predictions from
raw rows in any session that can import this package; :func:`load_pipeline` is that call.

Constants travel in the stages' own metadata.  What grows with the data does not: training rows of a nearest-neighbour model
and class tables beyond the listed bound are Parquet below ``path/tables``, which the stages name, so ``path`` must stay
where it is (or be exported again).  Rows with a null feature get a null vector or null prediction as the model's own
``transform`` gives them; extra columns pass through.
"""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from tablab.operators import supervised as V
from tablab.operators import transform as X


class _Constants(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A projection with fitted constants, kept as one JSON parameter."""

    constants = Param(Params._dummy(), "constants", "fitted constants as JSON text", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, constants: str | None = None):
        super().__init__()
        if constants is not None:
            self._set(constants=constants)

    @classmethod
    def of(cls, **values):
        return cls(constants=json.dumps(values))

    def values(self) -> dict:
        return json.loads(self.getOrDefault(self.constants))


class LabelCodes(_Constants):
    """Text features to the codes of the training table."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return V.encode_for_model(df, self.values())


class FeatureVector(_Constants):
    """Features, scaled if the model was fitted so, as the vector ``features``."""

    def _transform(self, df: DataFrame) -> DataFrame:
        v = self.values()
        return V._FeatureVector(v["features"], v["scale"]).transform(df)


class RandomFeatures(_Constants):
    """Random Fourier features in place of ``features``."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return V.apply_rff(df, self.values())


class LinearMachine(_Constants):
    """Prediction of linear weights (SVR)."""

    def _transform(self, df: DataFrame) -> DataFrame:
        from tablab.operators.svr import predict_linear

        return predict_linear(df, self.values())


class LandmarkMachine(_Constants):
    """Margins or prediction of an SVM or SVR on landmark features."""

    def _transform(self, df: DataFrame) -> DataFrame:
        from tablab.operators.kernels import predict_certified

        return predict_certified(df, self.values())


class NearestNeighbours(_Constants):
    """Prediction from the stored training rows."""

    def _transform(self, df: DataFrame) -> DataFrame:
        from tablab.operators.neighbors import knn_predict

        v = self.values()
        return knn_predict(df.sparkSession.read.parquet(v["table"]), df, v["key"], v["k"], v["classes"])


class MarginProbabilities(_Constants):
    """``probability`` from the margins of an SVM."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return V._with_platt(df, self.values()["platt"])


class ClassNames(_Constants):
    """``predicted``: the target's own value of a predicted class, and ``actual`` where rows have a ``label``."""

    def _transform(self, df: DataFrame) -> DataFrame:
        v = self.values()
        if "label" in df.columns:
            return V.with_class_names(df, v)
        return df.withColumn("predicted", V.class_value(v, "prediction"))


def pipeline_of(result: V.TrainResult, tables: str) -> PipelineModel:
    """The stages of a trained model; tables that grow with the data are written below ``tables``."""
    fm, prep, spark = result.model, result.prepared, result.predictions.sparkSession
    codes = {c: X.copy_code_table(spark, v, f"{tables}/codes-{i}") for i, (c, v) in enumerate(prep.feature_codes.items())}
    stages: list = [LabelCodes.of(feature_codes=codes)] if codes else []
    stages.append(FeatureVector.of(features=fm.features, scale=fm.scale_params))
    if fm.rff:
        stages.append(RandomFeatures.of(**fm.rff))
    if fm.svr is not None:
        stages.append(LinearMachine.of(**fm.svr))
    elif fm.knn is not None:
        fm.knn["train"].write.mode("overwrite").parquet(f"{tables}/train")
        stages.append(NearestNeighbours.of(table=f"{tables}/train", **{k: v for k, v in fm.knn.items() if k != "train"}))
    elif fm.kernel is not None:
        stages.append(LandmarkMachine.of(**fm.kernel))
    else:
        stages += fm.ml.stages
    if fm.platt:
        stages.append(MarginProbabilities.of(platt=fm.platt))
    if prep.class_codes is not None:
        stages.append(ClassNames.of(**prep.class_codes))
    return PipelineModel(stages)


def export_pipeline(result: V.TrainResult, path: str) -> PipelineModel:
    """Write the model as ``path/pipeline`` and return it; an earlier export there is replaced."""
    model = pipeline_of(result, f"{path}/tables")
    model.write().overwrite().save(f"{path}/pipeline")
    return model


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/pipeline")


__all__ = ["export_pipeline", "load_pipeline", "pipeline_of", "LabelCodes", "FeatureVector", "RandomFeatures", "LinearMachine",
           "LandmarkMachine", "NearestNeighbours", "MarginProbabilities", "ClassNames"]
