"""Operators for preparing training data at scale. Nothing else in spanlake imports this subpackage."""
