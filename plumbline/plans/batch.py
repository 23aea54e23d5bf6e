"""A whole evaluation from files: requests and dictionary in, predictions and one line of metrics out."""

from __future__ import annotations

import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.decide import Costs
from ..operators.evaluate import metrics
from ..sources import files
from ..sources.scratch import keep
from .lookup import Lookup, LookupParams


def evaluate_files(spark: SparkSession, requests: str, dictionary: str, predictions: str | None = None, channel: str | None = None, ranker=None, model: str | None = None, ablate: str | None = None, error_cost: float = 10.0) -> str:
    """Metrics of a lookup over labelled request lines, as one JSON object; predictions are written if a path is given.

    A request is timed as its share of the whole match, the dictionary's build
    left out.  Ids are unique; no request at all gives zeros.
    """
    chosen, warning = files.choose_ranker(spark, ranker, model)
    engine = Lookup(files.read_dictionary(spark, dictionary), chosen, Costs(error=error_cost), LookupParams(ablate=ablate), warning)
    asked = keep(files.read_requests(spark, requests, channel), "batch-requests")
    began = time.perf_counter()
    answers = keep(engine.match(asked).select("id", "candidates", "scores"), "batch-answers")
    each = (time.perf_counter() - began) * 1000 / max(asked.count(), 1)
    if predictions:
        files.write_predictions(answers, predictions)
    return files.metrics_line(metrics(answers.join(asked.select("id", "label"), "id").withColumn("ms", F.lit(each))))
