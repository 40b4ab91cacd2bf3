"""All queries of the library but those of the optional subpackage."""

from __future__ import annotations

from terraspan.plans import cells, cubes, gridding, polygons, sources, surfaces, wells

MODULES = (wells, surfaces, polygons, cells, cubes, gridding, sources)
QUERIES = {k: v for m in MODULES for k, v in m.R.queries.items()}
SQL = {k: v for m in MODULES for k, v in m.R.sql.items()}
