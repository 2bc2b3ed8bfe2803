"""Queries of this package and their SQL, gathered from one module per operator."""

from questline.llm import op01, op02, op03, op04, op05, op06, op07, op08, op09, op10, op11, op12, op13

_PARTS = (op01, op02, op03, op04, op05, op06, op07, op08, op09, op10, op11, op12, op13)

QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
