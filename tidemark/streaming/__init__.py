"""Watching files: quiet-period batches and re-analysis."""
