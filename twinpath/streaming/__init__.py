"""Streaming forms of the operators that are causal."""
