"""The small configuration file of a job, and its command line."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from collections.abc import Callable
from dataclasses import dataclass, fields
from pathlib import Path
from typing import TypeVar

from pyspark.sql import SparkSession

from fluxpanel.session import session

Config = TypeVar("Config")


def parsed(kind: type[Config], given: dict) -> Config:
    """The dataclass `kind` of a job's settings; unknown and missing ones are an error."""
    names = {f.name for f in fields(kind)}
    if unknown := sorted(set(given) - names):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    try:
        return kind(**given)
    except TypeError as error:
        raise ValueError(str(error)) from None


@dataclass
class Written:
    """What a run did: rows it read and wrote, and the periods or groups it touched."""

    rows_read: int
    rows_written: int
    touched: list[str]


def command_line(name: str, kind: type[Config], run: Callable[[SparkSession, Config], Written], argv: list[str] | None = None) -> int:
    """Reads the file, lets --name value replace its settings, and runs the job in a session of its own."""
    parser = argparse.ArgumentParser(prog=f"jobs.{name}", description=sys.modules[run.__module__].__doc__)
    parser.add_argument("--config", default=str(Path(__file__).with_name(f"{name}.json")))
    for f in fields(kind):
        parser.add_argument(f"--{f.name.replace('_', '-')}", type=int if "int" in str(f.type) else str)
    args = vars(parser.parse_args(argv))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    with open(args.pop("config")) as file:
        given = json.load(file)
    try:
        config = parsed(kind, given | {k: v for k, v in args.items() if v is not None})
    except ValueError as error:
        print(error, file=sys.stderr)
        return 2
    spark = session(f"jobs.{name}")
    try:
        run(spark, config)
    finally:
        spark.stop()
    return 0
