"""Spark ML pipelines: features, folds, training, evaluation, scoring."""
