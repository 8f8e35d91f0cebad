"""DataFrame operators over the evidence-graph tables."""
