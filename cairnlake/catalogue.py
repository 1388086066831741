"""Every registered query of the library and the SQL that says the same."""

from cairnlake.plans import find_queries, flow_queries, grid_queries, merge_queries, raster_queries

FAMILIES = [merge_queries, grid_queries, find_queries, raster_queries, flow_queries]
QUERIES = {name: query for family in FAMILIES for name, query in family.R.queries.items()}
SQL = {name: sql for family in FAMILIES for name, sql in family.R.sql.items()}
