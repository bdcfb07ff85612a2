"""Writers: stored review tables, the run registry and CSV export."""
