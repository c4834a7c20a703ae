"""Session analytics on Spark: segments, frame series, scores and reports as DataFrame operators."""
