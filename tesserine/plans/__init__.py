"""Queries over the domain tables and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def load() -> tuple[dict, dict]:
    from . import contained, evidence, explain, findings, graphs, investigation, knowledge, obfuscation, packages, reach, recorrelation, rules, semantics, snapshots, sources, vulnerabilities, workspace  # noqa: F401

    return QUERIES, SQL
