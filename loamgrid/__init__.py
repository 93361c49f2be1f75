"""A Spark-native engine for profiling, reshaping and cleaning tabular and textual data."""
