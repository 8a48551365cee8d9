"""Persisting fitted models (prep statistics + boosted stumps, or an MLlib model).

A fitted booster is a few hundred numbers: it is written as one small JSON document
through Spark (so it lands in the same shared storage as the data) and read back the
same way.  MLlib models use their own writer.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from surveylens.operators.boost import BoostedStumps
from surveylens.plans.prep import PrepModel


def save_model(spark: SparkSession, path: str, prep: PrepModel, model: BoostedStumps) -> None:
    doc = json.dumps({"prep": json.loads(prep.to_json()), "model": json.loads(model.to_json())})
    spark.createDataFrame([(doc,)], "doc string").coalesce(1).write.mode("overwrite").text(path)


def load_model(spark: SparkSession, path: str) -> tuple[PrepModel, BoostedStumps]:
    doc = json.loads(spark.read.text(path).first()[0])
    return PrepModel.from_json(json.dumps(doc["prep"])), BoostedStumps.from_json(json.dumps(doc["model"]))


def save_mllib(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_mllib(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)
