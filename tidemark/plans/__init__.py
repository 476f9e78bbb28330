"""Skew-safe building blocks: ordered scans, interval joins and sequential folds."""
