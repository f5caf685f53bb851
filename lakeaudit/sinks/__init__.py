"""Writers of runs and reports."""
