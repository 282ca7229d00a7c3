"""Settings of a run and the record of how it was made, both plain JSON."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import platform
import subprocess
import time
from pathlib import Path

from pyspark.sql import SparkSession


@dataclasses.dataclass(frozen=True)
class RunConfig:
    """Settings of inference and evaluation. ``smoke`` gives the small preset."""

    base_epsilon: float = 0.5493
    epsilon_scale: float = 1.0
    conflict_weight: float = 0.0
    budget_ratio: float = 1.0
    coupling: float = 0.5493
    grid_steps: int = 100
    threshold: float = 0.5
    replicates: int = 500
    families: tuple[str, ...] = ("blur", "noise", "downsample")
    severities: tuple[str, ...] = ("light", "medium", "heavy")
    seed: str = "run-1"

    def __post_init__(self) -> None:
        for name in ("base_epsilon", "epsilon_scale", "conflict_weight", "budget_ratio", "coupling"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")
        if self.grid_steps < 1 or not 0 < self.threshold < 1:
            raise ValueError("a grid needs a step, and the threshold lies between 0 and 1")

    @property
    def budget(self) -> float:
        """The budget: a multiple of the base radius, whatever the number of claims."""
        return self.budget_ratio * self.base_epsilon

    @classmethod
    def smoke(cls) -> RunConfig:
        return cls(grid_steps=20, replicates=50)

    @classmethod
    def load(cls, source: str | dict) -> RunConfig:
        """From a JSON file or a dict; an unknown setting is an error."""
        d = dict(source) if isinstance(source, dict) else json.loads(Path(source).read_text())
        unknown = d.keys() - {f.name for f in dataclasses.fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in d.items()})

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(dataclasses.asdict(self), indent=1, sort_keys=True))

    def digest(self) -> str:
        """SHA-256 of the settings, part of every cache key."""
        return hashlib.sha256(json.dumps(dataclasses.asdict(self), sort_keys=True).encode()).hexdigest()


def run_manifest(spark: SparkSession, config: RunConfig, run_id: str, inputs: dict[str, str], folder: str = ".") -> dict:
    """What a run was made of: settings, digests of its inputs, versions and the revision of the code (null outside a repository)."""
    try:
        revision = subprocess.run(["git", "-C", folder, "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10).stdout.strip() or None
    except (OSError, subprocess.SubprocessError):
        revision = None
    return {"run_id": run_id, "made_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "config": dataclasses.asdict(config), "config_digest": config.digest(), "inputs": dict(sorted(inputs.items())),
            "revision": revision, "versions": {"python": platform.python_version(), "spark": spark.version}, "parallelism": spark.sparkContext.defaultParallelism}
