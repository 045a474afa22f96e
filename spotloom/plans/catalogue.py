"""Queries by name and the SQL that should give the same rows."""

from spotloom.plans import feature_queries, model_queries, spot_queries, trajectory_queries

QUERIES: dict = {}
SQL: dict = {}
for part in (trajectory_queries, spot_queries, feature_queries, model_queries):
    QUERIES |= part.QUERIES
    SQL |= part.SQL
