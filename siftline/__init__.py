"""Rule-driven corpus analytics on Spark."""
