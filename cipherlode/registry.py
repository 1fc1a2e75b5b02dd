"""All queries of the library with their SQL."""

from __future__ import annotations

from cipherlode.plans import oracle
from cipherlode.plans import queries as plans


def entry(spark, sf_dir):
    return plans.entry(spark, sf_dir)


def queries():
    return dict(plans.QUERIES)


def oracle_sql():
    return {k: v for k, v in oracle.SQL.items() if k in plans.QUERIES}
