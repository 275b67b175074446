"""Evidence-gated data exploration on Spark."""
