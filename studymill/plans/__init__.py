"""Named relational plans over the study-content tables."""
