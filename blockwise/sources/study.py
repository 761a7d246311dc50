"""Re-summarise a study root (A10): one scan of all run logs, then the
summary with baseline comparison, the RJ x CF grid, its labels and the
validation curves; idempotent overwrite of the report folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from blockwise.operators import runs as R
from blockwise.session import cut
from blockwise.sources.runs import read_runs, run_inventory, write_grid, write_summary


def summarize_root(spark: SparkSession, root: str, experts: int = 8,
                   prefix: str | None = None, write: bool = True) -> dict[str, DataFrame]:
    """All reports are made of one table with a row per run, computed by one
    scan of the logs and kept in the shared folder (only the curves read the
    logs again, when they are asked for)."""
    logs = read_runs(spark, root, keep_empty=True)
    inv = run_inventory(spark, root)
    facts = cut(R.run_facts(logs, inv))
    summary = R.vs_baseline(R.summary_of(facts)).orderBy("run")
    cells = R.cells_of(facts, experts)
    out = {"summary": summary, "cells": cells, "curves": R.curves(logs, prefix),
           "labels": R.grid_labels(cells)}
    values = R.cf_values(cells)
    if values:                            # an empty grid has nothing to pivot
        out["grid"] = R.grid_pivot(cells, values)
    if write:
        write_summary(summary, root)
        if "grid" in out:
            write_grid(out["grid"], root, experts)
    return out
