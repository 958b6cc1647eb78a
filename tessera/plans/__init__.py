"""The library's queries over the given tables, each with its SQL where SQL can express it."""

from tessera.plans import catalogue, decisions, events, reports, rules, search, text

FLAGSHIP = "retrieve_fuse_decide"
QUERIES: dict = {}
SQL: dict = {}
for _module in (text, search, catalogue, decisions, events, reports, rules):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
