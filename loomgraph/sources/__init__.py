"""sources of the workflow-graph engine."""
