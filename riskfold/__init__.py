"""riskfold: a Spark-native credit feature, evaluation and scoring engine.

The package turns relational credit tables into one wide feature row per
client, evaluates binary classifiers under a business cost, and scores
clients in batch or micro-batch -- all as DataFrame / SQL / Spark ML plans.

Sub-packages
------------
sources    table binding, CSV / JSON / Parquet readers and writers, manifests
functions  column expressions and name utilities (no data movement)
operators  aggregation, join, encoding, ranking, sampling, evaluation blocks
plans      end-to-end plans (client feature table, model training, scoring)
streaming  Structured Streaming scoring of application records
"""

from riskfold.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
