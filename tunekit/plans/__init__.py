"""Compositions of operators: one chain, one generation, one study."""
