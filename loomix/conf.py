"""Settings: an override of this process, else the session's ``spark.loomix.*``, else the default."""

from __future__ import annotations

from pyspark.sql import SparkSession

PREFIX = "spark.loomix."
DEFAULTS: dict[str, str] = {
    "catalog": "",  # SQLite file of the catalog; empty: one in memory
    "shared": "",  # folder of the Parquet table that sessions share; empty: none
    "shareThreshold": "32",  # verified rewrites that are staged before they are appended
    "inlineWorker": "true",  # rewrite and verify at the first use; else leave it to a worker
    "pollIntervalSeconds": "5",
    "claimTimeoutSeconds": "600",
    "maxRetries": "3",
    "failCooldownSeconds": "86400",
    "maxExamples": "100",  # random rows that a rewrite is verified on
    "verifyTimeoutSeconds": "300",
    "tolerance": "0",
    "inputCategories": "numeric,string,bool,binary,timestamp,array,map",
    "targets": "sql,java",
    "sampling": "true",
    "maxSamples": "64",
    "requireApproval": "",  # of: array, map, string, ... by category of a parameter; or network, all
    "producers": "registry,lowering",
    "command": "",  # of the command producer
}
_own: dict[str, str] = {}


def override(**values) -> None:
    """Settings of this process; None takes one back."""
    for name, value in values.items():
        if name not in DEFAULTS:
            raise KeyError(f"no setting {name}")
        if value is None:
            _own.pop(name, None)
        else:
            _own[name] = str(value).lower() if isinstance(value, bool) else str(value)


def get(spark: SparkSession | None, name: str) -> str:
    if name in _own:
        return _own[name]
    return spark.conf.get(PREFIX + name, DEFAULTS[name]) if spark is not None else DEFAULTS[name]


def number(spark: SparkSession | None, name: str) -> float:
    return float(get(spark, name))


def flag(spark: SparkSession | None, name: str) -> bool:
    return get(spark, name).strip().lower() == "true"


def names(spark: SparkSession | None, name: str) -> list[str]:
    return [x.strip() for x in get(spark, name).split(",") if x.strip()]
