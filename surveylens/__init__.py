"""surveylens: survey analytics and classification on Spark DataFrames.

sources/    survey view, survey files, requests, model store
functions/  column expressions (names, encoders, interaction features, hash buckets)
operators/  profiling, cleaning, splits, metrics, boosted stumps, MLlib models
plans/      fit/apply preparation, training job, scoring, registered queries
streaming/  streaming scoring of requests
"""

__version__ = "0.1.0"
