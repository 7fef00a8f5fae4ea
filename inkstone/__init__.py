"""inkstone: text-corpus analytics on Spark."""
