"""All queries of the temporal-records engine, by name, and their SQL equivalents."""

from tidemark.jobs import parsing, privacy, records, search, summaries, upkeep

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (records, parsing, privacy, search, summaries, upkeep):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
