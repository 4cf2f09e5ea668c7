"""operators of the workflow-graph engine."""
