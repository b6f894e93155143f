"""Part of the batch retrieval engine."""
