"""Multi-rater scorecard analytics over semi-structured documents, on Spark."""
