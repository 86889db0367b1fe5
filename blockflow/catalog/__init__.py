"""Every operator as a query over the given tables, with its SQL twin where one exists."""

from blockflow.catalog import boxes, memory, plans, quality, runs, sequences, sources, streams, texts

QUERIES: dict = {}
ORACLES: dict = {}
for _area in [quality, boxes, runs, texts, memory, sequences, sources, streams, plans]:
    QUERIES.update(_area.QUERIES)
    ORACLES.update(_area.ORACLES)
