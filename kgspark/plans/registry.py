"""Every registered query with its SQL, over the derived tables."""

from __future__ import annotations

from pyspark import cloudpickle

import kgspark
from kgspark.plans.fixtures import Tables, oracle

cloudpickle.register_pickle_by_value(kgspark)  # helpers that run on executors travel with the job, so a cluster needs no copy of the package

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Registers fn(tables) -> DataFrame under name, with DuckDB SQL for the same rows if there is any."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return fn

    return add


from kgspark.plans import graph_queries, read_queries, search_queries, stream_queries, write_queries  # noqa: E402, F401
