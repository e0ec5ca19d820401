"""The registered queries over the given tables, by theme."""

from . import catalog, composed, files, judging, lookups, named, ranking, stored, texts

_MODULES = (catalog, composed, files, judging, lookups, named, ranking, stored, texts)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
