"""graphweir: graph retrieval, profiling and corpus preparation as Spark DataFrame operations."""
