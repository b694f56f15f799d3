"""All queries of the general operators."""

import importlib

_PARTS = [importlib.import_module(f"quern.queries.{name}") for name in ("analytics", "ordered", "corpus", "relational", "streams", "extended", "more")]
QUERIES = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
SQL = {k: v for part in _PARTS for k, v in part.SQL.items()}
