"""All queries of the library proper, with their DuckDB SQL."""

from __future__ import annotations

from quern.operators import blobs, catalogs, planning, records, series, similarity, tensors, vectors
from quern.sources import containers
from quern.streaming import flows

_PARTS = (similarity, vectors, records, catalogs, series, blobs, tensors, containers, planning, flows)

QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
