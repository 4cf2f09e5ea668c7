"""Projections of the given tables and the queries registered over them."""

from loomgraph.plans import queries, raw, findings, enriching, exchange  # noqa: F401, I001
