"""Collects the registered queries and their oracle SQL from the workload modules."""

from __future__ import annotations

from pathlib import Path

from sitegrain.session import tune
from workload import contacts, funnel, prompts, records, sites, streams, structure, tech

MODULES = [structure, tech, funnel, contacts, records, prompts, streams, sites]


ROOT = str(Path(__file__).resolve().parent.parent)


def tuned(query):
    """The query on a tuned session, whose Python workers find this repository wherever the driver was started."""

    def run(spark, folder):
        paths = spark.sparkContext.environment.get("PYTHONPATH", "")
        if ROOT not in paths.split(":"):
            spark.sparkContext.environment["PYTHONPATH"] = f"{ROOT}:{paths}".rstrip(":")
        return query(tune(spark), folder)

    return run


def queries():
    return {name: tuned(query) for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql():
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}


def flagship(spark, folder):
    return tuned(records.QUERIES["e1_fast_leads"])(spark, folder)
