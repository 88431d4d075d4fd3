"""DataFrame operators: profiling, checks, anomalies, trends, keyed writes, relational shapes."""
