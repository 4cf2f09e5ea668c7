"""Workflow-graph analytics on Spark: corpora of typed graphs as DataFrames."""
