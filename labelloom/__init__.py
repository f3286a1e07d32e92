"""labelloom: labelled free-text preparation, profiling, classification and evaluation on Spark."""
