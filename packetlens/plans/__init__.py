"""Jobs: batch analysis, training and reports."""
