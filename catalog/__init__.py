"""Registered queries over the test tables, each with its SQL counterpart where SQL can say it."""

from catalog import behaviour, evaluation, fold_terms, folds, modelling, payloads, texts

_AREAS = (behaviour, payloads, texts, folds, fold_terms, evaluation, modelling)


def all_queries():
    return {name: fn for area in _AREAS for name, fn in area.QUERIES.items()}


def all_sql():
    return {name: sql for area in _AREAS for name, sql in area.SQL.items()}
