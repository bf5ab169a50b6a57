"""Stateful streaming forms of the sequence operators."""
