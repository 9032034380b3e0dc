"""Queries by name over the tables, each a thin use of the operators, and their SQL."""

from __future__ import annotations


def _modules():
    from . import board, dataset, documents, evaluation, review, streams, validation

    return [validation, dataset, review, documents, streams, board, evaluation]


def all_queries() -> dict:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def all_sql() -> dict:
    return {k: v for m in _modules() for k, v in m.SQL.items()}
