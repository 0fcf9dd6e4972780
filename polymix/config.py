"""Options of a run, from a file of keys and values."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

ANALYSES = ("gaussian", "weibull", "horseshoe", "convert")


@dataclass(frozen=True)
class RunConfig:
    """``bed_file`` or ``sparse_base`` (or both: markers of which more than ``threshold`` isn't zero come packed), with the ``.fam`` file of the individuals.
    ``mixture`` is one row of variances for all markers, ``mixture_file`` with ``group_file`` a row per group. ``out`` is the common start of the
    files that are written."""

    analysis: str = "gaussian"
    bed_file: str = ""
    sparse_base: str = ""
    fam_file: str = ""
    phenotype_file: str = ""
    covariates_file: str = ""
    failure_file: str = ""
    group_file: str = ""
    mixture_file: str = ""
    mixture: str = "0.01,0.001,0.0001"
    priors_file: str = ""
    dirichlet_file: str = ""
    blocks_file: str = ""
    out: str = ""
    seed: int = 1
    chain_length: int = 10
    burn_in: int = 0
    thin: int = 1
    save: int = 10
    sync_rate: int = 0
    blocks: int = 8
    windows: int = 4
    threshold: float = 0.06
    shuffle: int = 1
    quad_points: int = 25
    tau0: float = 1.0
    v0_local: int = 3
    v0_tau: float = 3.0
    v0_slab: float = 3.0
    s0_slab: float = 1.0
    restart: int = 0

    def normalised(self) -> RunConfig:
        """States are saved at least as seldom as samples, and at a multiple of them (rounded down)."""
        if self.thin < 1 or self.chain_length < 0 or not 0 <= self.burn_in:
            raise ValueError("thin is at least 1, lengths aren't negative")
        if self.analysis not in ANALYSES:
            raise ValueError(f"analysis is one of {', '.join(ANALYSES)}")
        if bool(self.group_file) != bool(self.mixture_file):
            raise ValueError("groups and their mixtures come together")
        save = max(self.save, self.thin)
        return replace(self, save=save - save % self.thin)


def read_config(spark: SparkSession, path: str) -> RunConfig:
    """Lines ``key value``; // and # begin a comment (// only after a blank or at the start: addresses hold it), - and _ are alike in keys, an unknown key
    or a missing value is an error."""
    line = F.trim(F.regexp_replace("value", r"((^|\s)//|#).*$", ""))
    known, given = {f.name: f.type for f in fields(RunConfig)}, {}
    for r in spark.read.text(path).select(line.alias("line")).filter("line <> ''").collect():  # some lines of options
        key, _, value = r.line.replace("\t", " ").partition(" ")
        key = key.lstrip("-").replace("-", "_")
        if key not in known or not value.strip():
            raise ValueError(f"option {key!r} is not known or has no value")
        given[key] = {"int": int, "float": float}.get(known[key], str)(value.strip())
    return RunConfig(**given).normalised()
