"""Run configuration: YAML with ``defaults`` and a list of ``runs``."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field
from typing import Any

log = logging.getLogger(__name__)

#: Keys and what they are if nobody sets them.
DEFAULTS: dict[str, Any] = {
    "clinical_file": "*.tsv", "prefilter": [], "genotype_prefix": None, "derive": {}, "output_dir": "results", "sample_id_col": "IID",
    "time_col": None, "covariates": [], "strata": [None], "strata_col": None, "predictor_source": "genetic", "min_n": 30,
    "zscore_predictors": True, "zscore_binary": False, "zscore_dosage": False, "maf_min": 0.01, "mac_min": 20, "missing_max": 0.05,
    "spa_p_cutoff": 0.01, "spa_maf_cutoff": 0.05, "predictor_at": "all",
}
ALPHA, GENOMEWIDE = 0.05, 5e-8
MODELS = ("linear", "logistic", "cox", "slope", "gallop", "trajgwas")
#: Keys that this engine leaves to Spark.
LEFT_TO_SPARK = ("device", "max_cpus", "max_ram_gb", "max_gpu_mem_gb", "block_size", "prefetch")


@dataclass
class Run:
    name: str
    model: str
    spec: dict[str, Any]
    defaults: dict[str, Any]

    def get(self, key: str, default: Any = None) -> Any:
        """The run's own value, else the default section's, else the built-in one."""
        for source in (self.spec, self.defaults, DEFAULTS):
            if source.get(key) is not None:
                return source[key]
        return default

    @property
    def covariates(self) -> list[str]:
        """Default covariates, then added ones, each once, without dropped ones."""
        every = dict.fromkeys([*self.get("covariates", []), *(self.spec.get("add_covariates") or [])])
        return [c for c in every if c not in (self.spec.get("drop_covariates") or [])]

    @property
    def strata(self) -> list[str | None]:
        strata = self.get("strata", [None])
        return [None if s is None or str(s).lower() == "null" else str(s) for s in (strata if isinstance(strata, list) else [strata])]


@dataclass
class Config:
    defaults: dict[str, Any] = field(default_factory=dict)
    runs: list[Run] = field(default_factory=list)


def parse(raw: Any) -> Config:
    """Checks a configuration mapping; ``runs`` must be a list, names and models known."""
    if not isinstance(raw, dict) or not isinstance(raw.get("runs"), list):
        raise ValueError("a configuration needs a list of runs")
    defaults = {**(raw.get("defaults") or {})}
    for key in LEFT_TO_SPARK:
        if key in defaults:
            log.warning("%s is left to Spark", key)
    runs = []
    for spec in raw["runs"]:
        model = str(spec.get("model") or "linear").lower()
        if model not in MODELS:
            raise ValueError(f"unknown model {model!r}")
        run = Run(str(spec.get("name") or "unnamed"), model, spec, defaults)
        if run.strata != [None] and not run.get("strata_col"):
            raise ValueError(f"{run.name}: strata need strata_col")
        if run.get("predictor_at") != "all":
            log.warning("%s: predictor_at has no effect", run.name)
        runs.append(run)
    return Config(defaults, runs)


def load(path: str) -> Config:
    import yaml

    with open(path) as f:
        return parse(yaml.safe_load(f))
