"""Whole jobs and named queries composed from sources, operators and sinks."""
