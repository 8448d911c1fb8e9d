"""All registered queries of the series half."""

from __future__ import annotations

from . import brains, decisions, keeping, learned, outcomes, profiles, queries, records, walk

QUERIES = {**queries.QUERIES, **decisions.QUERIES, **outcomes.QUERIES, **records.QUERIES, **learned.QUERIES, **walk.QUERIES, **brains.QUERIES, **keeping.QUERIES, **profiles.QUERIES}
SQL = {**queries.SQL, **decisions.SQL, **outcomes.SQL, **records.SQL, **learned.SQL, **walk.SQL, **brains.SQL, **keeping.SQL, **profiles.SQL}
