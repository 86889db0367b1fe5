"""Operators for training-data pipelines, each with a query over the given tables."""

from blockflow.llm import (
    alignment, backoff, bpe, curves, licences, lines, merkle, mixture, packing, quadratic, sanitise,
    sketches, warc,
)

QUERIES: dict = {}
ORACLES: dict = {}
for _area in [alignment, backoff, bpe, curves, licences, lines, merkle, mixture, packing, quadratic,
              sanitise, sketches, warc]:
    QUERIES.update(_area.QUERIES)
    ORACLES.update(_area.ORACLES)
