"""Operators for building training data for language models. Nothing else in flowlab imports this."""
