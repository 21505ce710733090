"""Test-then-train evaluation of online logistic regression on Spark DataFrames."""

from prequenta.model import Model, cold_model
from prequenta.operators.evaluate import (
    accuracy,
    accuracy_json,
    confusion_counts,
    confusion_pivot,
    counter_keys,
)
from prequenta.operators.fit import OFFLINE, ONLINE, SgdSettings, lbfgs_fit, optimality, sgd_fit
from prequenta.operators.parse import drop_header, named_rows, parse_labelled, publish_payload, split_rejects
from prequenta.operators.report import as_of, last_points, running_accuracy
from prequenta.operators.score import score
from prequenta.operators.split import bootstrap_sample, hash_split, random_split
from prequenta.sources.counts import CountTable
from prequenta.sources.models import load_any, load_models, load_platform_model, save_models, save_platform_model
from prequenta.sources.text import read_header, read_labelled_csv, read_lines
from prequenta.sources.topic import read_topic, write_topic
from prequenta.streaming.prequential import (
    latest_run,
    newest_points,
    open_run,
    read_counts,
    read_progress,
    read_rejects,
    read_totals,
    run_prequential,
)

__all__ = [
    "CountTable",
    "Model",
    "OFFLINE",
    "ONLINE",
    "SgdSettings",
    "accuracy",
    "accuracy_json",
    "as_of",
    "bootstrap_sample",
    "cold_model",
    "confusion_counts",
    "confusion_pivot",
    "counter_keys",
    "drop_header",
    "hash_split",
    "last_points",
    "latest_run",
    "lbfgs_fit",
    "load_any",
    "load_models",
    "load_platform_model",
    "named_rows",
    "newest_points",
    "open_run",
    "optimality",
    "parse_labelled",
    "publish_payload",
    "random_split",
    "read_counts",
    "read_header",
    "read_labelled_csv",
    "read_lines",
    "read_progress",
    "read_rejects",
    "read_topic",
    "read_totals",
    "run_prequential",
    "running_accuracy",
    "save_models",
    "save_platform_model",
    "score",
    "sgd_fit",
    "split_rejects",
    "write_topic",
]
