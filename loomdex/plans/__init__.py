"""The registered queries with the SQL that checks them."""

from . import graphs, ranking, relational, requests, shapes, sources, texts

MODULES = (graphs, ranking, relational, requests, texts, sources, shapes)


def queries():
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracles():
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
