"""Rules over streams of triples."""

from .incremental import apply_rules

__all__ = ["apply_rules"]
