"""The queries of the subpackage, with the SQL of those that SQL can express."""

from liame.llm import frequency, leaks, lines, mixing, names, pairs, private, topn, truncation, visual

MODULES = (pairs, names, lines, visual, topn, frequency, truncation, leaks, mixing, private)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
