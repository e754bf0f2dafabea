"""Compositions of operators: scenarios, city questions, the temporal dataset, models."""
