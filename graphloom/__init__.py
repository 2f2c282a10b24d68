"""Graph, event-log and corpus analytics on PySpark DataFrames."""
