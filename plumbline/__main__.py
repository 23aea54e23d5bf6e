"""``python -m plumbline``: evaluate a lookup over labelled requests and print its metrics as one JSON object."""

import argparse

from pyspark.sql import SparkSession

from .plans.batch import evaluate_files


def main(arguments: list[str] | None = None) -> None:
    """Parse the command line, run, print."""
    p = argparse.ArgumentParser(prog="plumbline", description=__doc__)
    p.add_argument("--requests", required=True, help="labelled request lines (JSON)")
    p.add_argument("--dictionary", required=True, help="dictionary lines (JSON)")
    p.add_argument("--predictions", help="folder that the predictions are written to")
    p.add_argument("--channel", choices=["voice", "webchat"], help="requests of one channel alone")
    p.add_argument("--ranker", choices=["manual", "logreg"])
    p.add_argument("--model", help="model file of the logreg ranker")
    p.add_argument("--ablate", choices=["whole_string", "no_phonetic"])
    p.add_argument("--error-cost", type=float, default=10.0, help="cost of a wrong answer in questions")
    a = p.parse_args(arguments)
    spark = SparkSession.builder.appName("plumbline").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    print(evaluate_files(spark, a.requests, a.dictionary, a.predictions, a.channel, a.ranker, a.model, a.ablate, a.error_cost))


if __name__ == "__main__":
    main()
