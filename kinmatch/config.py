"""Strict configurations: unknown keys, wrong types and impossible values are refused."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from pathlib import Path, PurePosixPath, PureWindowsPath
from typing import Any

from kinmatch.errors import ConfigurationError


def read_mapping(path: str) -> dict[str, Any]:
    """A YAML or JSON mapping; YAML needs its library installed."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        value = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as e:
            raise ConfigurationError("YAML configurations need the yaml library") from e
        value = yaml.safe_load(text)
    if not isinstance(value, dict):
        raise ConfigurationError(f"{path} is not a mapping")
    return value


def build(kind: type, values: dict[str, Any]):
    """A dataclass from a mapping with exactly its fields; whole numbers pass for floats, nothing else is coerced."""
    fields = {f.name: f for f in dataclasses.fields(kind)}
    if unknown := sorted(set(values) - set(fields)):
        raise ConfigurationError(f"unknown keys {unknown}")
    missing = [n for n, f in fields.items() if n not in values and f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING]
    if missing:
        raise ConfigurationError(f"missing keys {missing}")
    plain = {"int": int, "float": (int, float), "str": str, "bool": bool, "tuple": (list, tuple)}
    out = {}
    for n, v in values.items():
        want = plain.get(str(fields[n].type).partition("[")[0])
        if want and (not isinstance(v, want) or (isinstance(v, bool) and want is not bool)):
            raise ConfigurationError(f"{n} has the wrong type")
        out[n] = tuple(v) if isinstance(v, list) else v
    return kind(**out)


def safe_relative(path: str) -> str:
    """The path if it is relative and stays below its folder under POSIX and Windows rules."""
    for p in (PurePosixPath(path), PureWindowsPath(path)):
        if p.is_absolute() or p.drive or ".." in p.parts:
            raise ConfigurationError(f"unsafe path {path!r}")
    return path


def file_digest(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            h.update(part)
    return h.hexdigest()


def text_digest(path: str) -> str:
    """Digest of a text file that line ends do not change."""
    return hashlib.sha256(Path(path).read_bytes().replace(b"\r\n", b"\n")).hexdigest()


def verified(path: str, digest: str) -> str:
    if digest not in (file_digest(path), text_digest(path)):
        raise ConfigurationError(f"{path} is not the file that was frozen")
    return path


def rising(name: str, values: tuple, low: float | None = None, high: float | None = None) -> None:
    """Values have to be unique, in order and in range."""
    if list(values) != sorted(set(values)) or not values:
        raise ConfigurationError(f"{name} has to rise")
    if (low is not None and values[0] < low) or (high is not None and values[-1] > high):
        raise ConfigurationError(f"{name} is out of range")


@dataclasses.dataclass(frozen=True)
class RetrievalConfig:
    """Depths of a retrieval run."""

    metric_ks: tuple
    candidate_k: int
    target_recall: float
    split: str = "validation"

    def __post_init__(self):
        rising("metric_ks", self.metric_ks, low=1)
        if self.candidate_k < self.metric_ks[-1]:
            raise ConfigurationError("rankings have to cover the largest metric depth")
        if self.split != "validation":
            raise ConfigurationError("parameters are chosen on the validation split only")


@dataclasses.dataclass(frozen=True)
class MiningConfig:
    """Bounds of hard-negative mining."""

    minimum_probability: float
    maximum_probability: float
    candidate_k: int
    negatives_per_query: int
    variant_share: float

    def __post_init__(self):
        if not 0 <= self.minimum_probability < self.maximum_probability <= 1:
            raise ConfigurationError("probability bounds have to rise inside [0, 1]")
        if self.candidate_k < self.negatives_per_query:
            raise ConfigurationError("fewer candidates than negatives")
        if not 0 <= self.variant_share < 1:
            raise ConfigurationError("variant share has to be in [0, 1)")


@dataclasses.dataclass(frozen=True)
class ClusterConfig:
    """Grid of a clustering sweep."""

    thresholds: tuple
    reciprocal_ranks: tuple
    coverages: tuple
    override: float
    maximum_size: int
    margin: float

    def __post_init__(self):
        rising("thresholds", self.thresholds, 0, 1)
        rising("reciprocal_ranks", self.reciprocal_ranks, low=1)
        rising("coverages", self.coverages, 0, 1)
        if self.override < self.thresholds[0]:
            raise ConfigurationError("override lies below every threshold")

    def settings(self) -> list[dict]:
        return [
            {"threshold": t, "reciprocal": r, "coverage": c, "override": self.override, "most": self.maximum_size, "margin": self.margin, "name": f"t{t}_r{r}_c{c}"}
            for t in self.thresholds for r in self.reciprocal_ranks for c in self.coverages
        ]
