"""The training job: read -> fit prep -> compare -> grid search -> refit best -> save.

Unlike the study, the final booster is refitted with the best grid parameters (the
study set them on an already-fitted model without refitting), and the holdout part
is scored as well as the training part.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveylens import schema as S
from surveylens.operators import boost as B
from surveylens.operators import grids as GR
from surveylens.operators import metrics as M
from surveylens.operators import split as SP
from surveylens.plans import prep as PR
from surveylens.sources import model_store as MS


@dataclass
class TrainingResult:
    prep: PR.PrepModel
    model: B.BoostedStumps
    best_params: dict
    grid: list[dict] = field(default_factory=list)
    comparison: list[dict] = field(default_factory=list)
    scores: dict = field(default_factory=dict)


def adaboost_predict_model(raw: DataFrame, key: str = "id",
                           n_estimators: list[int] | None = None,
                           learning_rates: list[float] | None = None,
                           folds: int = S.ADABOOST_GRID_FOLDS,
                           compare: list[str] | None = None) -> TrainingResult:
    """60/40 split, model comparison on the training part (unset: the job's own models; empty:
    none), grid search, refit, holdout score."""
    compare = GR.TRAINING_JOB_MODELS if compare is None else compare
    n_estimators = n_estimators or S.ADABOOST_GRID["n_estimators"]
    learning_rates = learning_rates or S.ADABOOST_GRID["learning_rate"]
    train_raw, test_raw = SP.train_test_split(raw, key=key)
    prep = PR.fit_prep(train_raw)
    train = PR.apply_prep(train_raw, prep)
    test = PR.apply_prep(test_raw, prep)
    result_cmp: list[dict] = []
    if compare:
        tables = GR.Tables(SP.with_folds(train, S.COMPARISON_FOLDS), S.FEATURES, S.TARGET)
        result_cmp = [r.asDict() for r in GR.compare(tables, {m: (m, {}) for m in compare}).collect()]
        tables.drop()
    grid, _ = B.grid_search(SP.with_folds(train, folds), S.FEATURES, S.TARGET,
                            n_estimators, learning_rates, folds)
    rows = [r.asDict() for r in grid.collect()]
    best = max(rows, key=lambda r: (r["mean_accuracy"], -r["n_estimators"], -r["learning_rate"]))
    params = {"n_estimators": int(best["n_estimators"]), "learning_rate": float(best["learning_rate"])}
    model = B.fit_boosted_stumps(train, S.FEATURES, S.TARGET,
                                 [B.BoostSpec("final", F.lit(True), params["learning_rate"],
                                              params["n_estimators"])])["final"]
    scores = {}
    for name, part in (("train", train), ("test", test)):
        scored = model.transform(part).select(F.col(S.TARGET).cast("int").alias("label"), "prediction")
        scores[name] = M.binary_metrics(scored).first().asDict()
    return TrainingResult(prep, model, params, rows, result_cmp, scores)


def run_training(spark: SparkSession, survey: DataFrame | str, model_path: str,
                 fmt: str = "csv", **kw) -> TrainingResult:
    """The job's main(): read, train, persist prep statistics + booster to ``model_path``."""
    if isinstance(survey, str):
        from surveylens.sources.survey_io import read_survey
        survey = read_survey(spark, survey, fmt=fmt)
    result = adaboost_predict_model(survey, **kw)
    MS.save_model(spark, model_path, result.prep, result.model)
    return result
