"""Operators for preparing training corpora; nothing else in ``tessera`` imports this package."""
