"""What the jobs share: their config and their log."""

from __future__ import annotations

import json
import logging
from pathlib import Path

from pyspark.sql import SparkSession

log = logging.getLogger("jobs")


def read_config(spark: SparkSession, path: str) -> dict:
    """A JSON config from anywhere that Spark reads."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def shipped_config(name: str) -> dict:
    """The config that ships beside the job."""
    return json.loads((Path(__file__).parent / f"{name}.json").read_text())


def start_log() -> None:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
