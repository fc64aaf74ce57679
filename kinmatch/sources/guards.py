"""Gates before results are published and before the test split is looked at."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame

from kinmatch.errors import ConfigurationError, ContractError
from kinmatch.operators.audit import audit_status
from kinmatch.sources.sinks import write_table_once


def publish(rows: DataFrame, findings: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Write ``rows`` unless a finding is critical; returns the status of the audit."""
    status = audit_status(findings).first()["status"]
    if status == "blocked":
        raise ContractError("critical findings block the publication")
    write_table_once(rows, path, fmt)
    return status


def frozen_policy(frozen: dict, selected: dict) -> dict:
    """The frozen policy, if each of its values is the one that validation selected."""
    wrong = sorted(k for k, v in frozen.items() if k not in selected or selected[k] != v)
    if wrong:
        raise ConfigurationError(f"frozen values differ from the selected ones: {wrong}")
    return frozen


def claim_test_access(path: str, facts: dict) -> None:
    """Leave the marker of the one look at the test split; an error if there is one already."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    try:
        fd = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
    except FileExistsError as e:
        raise ContractError("the test split was looked at before") from e
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        json.dump(facts, f, sort_keys=True)


def latency_profile(run: Callable[[], object], repeats: int, warm: int = 1) -> dict[str, float]:
    """Milliseconds of single calls on the driver: ``p50, p95, mean``, by nearest rank."""
    if repeats < 1:
        raise ConfigurationError("a profile needs a call")
    for _ in range(warm):
        run()
    times = []
    for _ in range(repeats):
        began = time.perf_counter()
        run()
        times.append(1000 * (time.perf_counter() - began))
    times.sort()
    at = lambda q: times[round(q * (len(times) - 1))]
    return {"p50": at(0.5), "p95": at(0.95), "mean": sum(times) / len(times)}
