"""Preparation and booster as ``pyspark.ml`` stages, so that one saved pipeline scores raw files.

``Pipeline(stages=[SurveyPrep(), StumpBooster()]).fit(raw)`` learns the preparation's
statistics and boosts stumps on the prepared rows; ``PipelineModel.load`` reads both back.  A
stage's learnt values are a small JSON document beside its metadata, written through Spark.

Edge cases: a raw table may lack the target when it is scored; rows without a label do not
take part in boosting; scoring an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
                             MLReadable, MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveylens import schema as S
from surveylens.operators import boost as B
from surveylens.plans import prep as PR


class _DocumentWriter(MLWriter):
    def __init__(self, stage) -> None:
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        doc = self.sparkSession.createDataFrame([(self.stage.fitted.to_json(),)], "doc string")
        doc.coalesce(1).write.text(f"{path}/fitted")


class _DocumentReader(MLReader):
    def __init__(self, kind) -> None:
        super().__init__()
        self.kind = kind

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = self.kind(self.kind.holds.from_json(self.sparkSession.read.text(f"{path}/fitted").first()[0]))
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        return stage


class _FittedStage(Model, MLReadable, MLWritable):
    """A model whose state is ``fitted``, an object with ``to_json`` and ``from_json``."""
    holds: type

    def __init__(self, fitted=None) -> None:
        super().__init__()
        self.fitted = fitted

    def write(self) -> MLWriter:
        return _DocumentWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _DocumentReader(cls)

    def copy(self, extra=None):
        that = super().copy(extra)
        that.fitted = self.fitted
        return that


class SurveyPrepModel(_FittedStage):
    """Raw survey rows to key, model inputs and, if there, the target."""
    holds = PR.PrepModel

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return PR.apply_prep(dataset, self.fitted)


class SurveyPrep(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    def _fit(self, dataset: DataFrame) -> SurveyPrepModel:
        return SurveyPrepModel(PR.fit_prep(dataset))


class StumpBoosterModel(_FittedStage):
    """Prepared rows with ``decision`` and ``prediction``."""
    holds = B.BoostedStumps

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.fitted.transform(dataset)


class StumpBooster(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    nEstimators = Param(Params._dummy(), "nEstimators", "number of stumps", TypeConverters.toInt)
    learningRate = Param(Params._dummy(), "learningRate", "shrinkage of the stumps' votes", TypeConverters.toFloat)

    def __init__(self, nEstimators: int = S.ADABOOST_DEFAULTS["n_estimators"],
                 learningRate: float = S.ADABOOST_DEFAULTS["learning_rate"]) -> None:
        super().__init__()
        self._set(nEstimators=nEstimators, learningRate=learningRate)

    def _fit(self, dataset: DataFrame) -> StumpBoosterModel:
        spec = B.BoostSpec("m", F.lit(True), self.getOrDefault(self.learningRate), self.getOrDefault(self.nEstimators))
        return StumpBoosterModel(B.fit_boosted_stumps(dataset, S.FEATURES, S.TARGET, [spec])["m"])
