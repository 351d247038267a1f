"""What both jobs' command lines share: a JSON config file, options that override it, a log, a session that is created and stopped here alone."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from collections.abc import Callable


def settings(config: dict, arguments: list[str], required: tuple[str, ...]) -> dict:
    """The config with ``--name value`` in place of what it says; values are read as JSON where they are, else as text."""
    parser = argparse.ArgumentParser()
    parser.add_argument("--config", default=None)
    for name in (*config, *(r for r in required if r not in config)):
        parser.add_argument(f"--{name.replace('_', '-')}", default=None)
    given = {k: v for k, v in vars(parser.parse_args(arguments)).items() if v is not None and k != "config"}
    for name, value in given.items():
        try:
            given[name] = json.loads(value)
        except ValueError:
            given[name] = value
    merged = config | given
    missing = [r for r in required if not merged.get(r)]
    if missing:
        raise SystemExit(f"not set: {', '.join(missing)}")
    return merged


def main(job: Callable, config_file: str, required: tuple[str, ...], arguments: list[str] | None = None) -> int:
    """Runs ``job(spark, **settings)`` in a session of its own."""
    from pyspark.sql import SparkSession

    arguments = sys.argv[1:] if arguments is None else arguments
    logging.basicConfig(level=logging.WARNING, format="%(asctime)s %(levelname)s %(name)s %(message)s")
    logging.getLogger("jobs").setLevel(logging.INFO)
    chosen = arguments[arguments.index("--config") + 1] if "--config" in arguments else config_file
    with open(chosen) as file:
        merged = settings(json.load(file), arguments, required)
    spark = SparkSession.builder.appName(job.__module__).getOrCreate()
    try:
        job(spark, **merged)
    finally:
        spark.stop()
    return 0
