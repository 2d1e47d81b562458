"""Incremental forms of the segment operators for unbounded recordings."""
