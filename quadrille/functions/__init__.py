"""Functions of the temporal knowledge-graph engine."""
