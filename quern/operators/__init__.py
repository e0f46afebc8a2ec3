"""Relational operators: detectors, verdicts, retrieval, eviction, graphs, logs."""
