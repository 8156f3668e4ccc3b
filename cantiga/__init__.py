"""A PySpark engine for time-aligned text: normalisation, alignment, timelines and scoring as DataFrame operations."""
