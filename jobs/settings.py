"""Command lines of the jobs: a JSON file of settings, which flags override."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable


def main(job: Callable, flags: dict[str, str], argv: list[str] | None = None) -> None:
    """Run ``job(spark, **settings)`` in a session of its own. ``flags``: name to help."""
    parser = argparse.ArgumentParser(description=(job.__doc__ or "").split("\n")[0])
    parser.add_argument("--config", help="JSON file with any of the other settings")
    for name, text in flags.items():
        parser.add_argument(f"--{name.replace('_', '-')}", dest=name, help=text)
    given = vars(parser.parse_args(argv))
    settings = {}
    if path := given.pop("config"):
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
    if unknown := set(settings) - set(flags):
        parser.error(f"unknown settings: {', '.join(sorted(unknown))}")
    settings |= {k: v for k, v in given.items() if v is not None}
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName(job.__module__).getOrCreate()
    try:
        job(spark, **settings)
    finally:
        spark.stop()
