"""DataFrame operators. `keys` name the sequence that a row belongs to; no operator orders rows across sequences."""
