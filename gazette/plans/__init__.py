"""Jobs: whole pipelines over stored tables."""
