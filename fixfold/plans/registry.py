"""All registered queries and their DuckDB twins, gathered from the slice modules."""

from __future__ import annotations

import importlib

# Slice modules, each exposing QUERIES (name -> fn(spark, sf_dir)) and ORACLE (name -> SQL).
SLICES = (
    "fixfold.plans.vote_plans",
    "fixfold.plans.grade_plans",
    "fixfold.plans.curate_plans",
    "fixfold.plans.collect_plans",
    "fixfold.plans.retrieve_plans",
    "fixfold.plans.misc_plans",
    "fixfold.plans.locate_plans",
    "fixfold.plans.stream_plans",
    "fixfold.plans.io_plans",
)


def _load():
    queries, oracle = {}, {}
    for mod_name in SLICES:
        mod = importlib.import_module(mod_name)
        for name in mod.QUERIES:
            if name in queries:
                raise ValueError(f"query {name!r} registered twice")
        queries.update(mod.QUERIES)
        oracle.update(getattr(mod, "ORACLE", {}))
    return queries, oracle


def all_queries():
    return _load()[0]


def all_oracle_sql():
    return _load()[1]
