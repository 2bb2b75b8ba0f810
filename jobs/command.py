"""What the jobs' command lines share: arguments, the config file, logging, the session."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import SparkSession


def read_config(spark: SparkSession, path: str) -> dict:
    """The settings of a JSON file, which may be remote."""
    return json.loads(spark.read.text(path, wholetext=True).first().value)


def run(job: Callable[..., dict], paths: dict[str, str], argv: list[str] | None = None) -> dict:
    """``job(spark, **paths, **settings)`` with the paths of the command line and the settings of its config file.

    Only here is a session made and stopped."""
    parser = argparse.ArgumentParser(description=job.__doc__)
    for name, meaning in paths.items():
        parser.add_argument(f"--{name}", required=True, help=meaning)
    parser.add_argument("--config", help="a JSON file of settings")
    given = vars(parser.parse_args(argv))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(job.__name__).getOrCreate()
    try:
        config = given.pop("config")
        return job(spark, **given, **(read_config(spark, config) if config else {}))
    finally:
        spark.stop()
