"""Registered queries of the league and of names, and their SQL."""

from pitchlake.plans import league_queries, name_queries

QUERIES = league_queries.QUERIES | name_queries.QUERIES
ORACLE_SQL = league_queries.SQL | name_queries.SQL
