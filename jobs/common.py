"""What the jobs share: configuration files, rules, sessions for the command line, unique folders."""

from __future__ import annotations

import logging
import tomllib
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

from siftline.session import shared_dir
from siftline.sources.packs import BUILT_IN, SEVERITIES, Registry, Rule, load_pack


class ConfigError(ValueError):
    """A configuration that can't be used; the message says why."""


def load_config(job_file: str, path: str | None = None) -> dict:
    """The configuration of a job: a file of the driver, by default the one beside the job."""
    return tomllib.loads(Path(path or Path(job_file).with_suffix(".toml")).read_text("utf-8"))


def pattern_rules(packs: list[str]) -> list[Rule]:
    """Pattern rules of built-in packs and of pack folders."""
    registry = Registry([load_pack(BUILT_IN / p if (BUILT_IN / p).is_dir() else p) for p in packs])
    rules = [r for r in registry.rules if r.capability == "pattern"]
    if not rules:
        raise ConfigError(f"packs {packs} have no pattern rules")
    return rules


def severity(config: dict, key: str, default: str) -> str:
    value = config.get(key, default)
    if value not in SEVERITIES:
        raise ConfigError(f"{key}: unknown severity '{value}'; known: {', '.join(SEVERITIES)}")
    return value


def session(name: str) -> SparkSession:
    """A session for a command line; masters and sizes come from spark-submit or the defaults of the cluster."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder that no other call uses, in the place that driver and executors share."""
    return f"{shared_dir(spark)}/jobs/{name}-{uuid.uuid4().hex}"
