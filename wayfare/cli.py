"""Command line: ``python -m wayfare.cli simulate|route parameters.json``."""

from __future__ import annotations

import argparse
import io
import logging
import os
import sys


def start_logging(folder: str) -> io.StringIO | None:
    """Everything to ``log.txt`` in the output folder, information to the terminal.  A store that cannot be appended to gets the file
    at the end, from what is returned."""
    log = logging.getLogger("wayfare")
    log.setLevel(logging.DEBUG)
    held = io.StringIO() if "://" in folder else None
    if held is None:
        os.makedirs(folder or ".", exist_ok=True)
    file = logging.FileHandler(os.path.join(folder, "log.txt"), mode="w") if held is None else logging.StreamHandler(held)
    file.setLevel(logging.DEBUG)
    terminal = logging.StreamHandler()
    terminal.setLevel(logging.INFO)
    for handler in (file, terminal):
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(handler)
    return held


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="wayfare")
    parser.add_argument("job", choices=("simulate", "route"))
    parser.add_argument("parameters")
    given = parser.parse_args(arguments)
    from pyspark.sql import SparkSession

    from wayfare.plans import parameters, routing_job, simulation
    from wayfare.sources import files

    read, run = (parameters.simulation_parameters, simulation.run) if given.job == "simulate" else (parameters.routing_parameters, routing_job.run)
    spark, held, p = SparkSession.builder.getOrCreate(), None, None
    try:
        p = read(given.parameters)
        held = start_logging(p.output_directory)
        run(spark, p)
    except Exception:
        logging.getLogger("wayfare").exception("the job failed")
        return 1
    finally:
        if held is not None:
            files.write_bytes(f"{p.output_directory.rstrip('/')}/log.txt", held.getvalue().encode(), spark)
    return 0


if __name__ == "__main__":
    sys.exit(main())
