"""Queries over the library's own operators and their SQL."""

from __future__ import annotations

from evidra.plans import constraint_queries, evaluation_queries, ingest_queries, more_queries, registry_queries, retrieval_queries, rule_queries, store_queries
from evidra.plans.dialect import Duck, Spark, ran
from evidra.plans.statements import PLANS

_PARTS = (retrieval_queries, more_queries, rule_queries, ingest_queries, constraint_queries, evaluation_queries, store_queries, registry_queries)
QUERIES: dict = {name: (lambda spark, sf_dir, f=f: ran(spark, sf_dir, f(Spark))) for name, f in PLANS.items()} | {k: v for part in _PARTS for k, v in part.QUERIES.items()}
for _name, _f in QUERIES.items():
    _f.__name__ = _name
SQL: dict[str, str] = {name: f(Duck) for name, f in PLANS.items()} | {k: v for part in _PARTS for k, v in part.SQL.items()}
