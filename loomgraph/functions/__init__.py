"""functions of the workflow-graph engine."""
