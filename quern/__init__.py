"""quern: retrieval, decision and content analytics as composable Spark DataFrame functions."""
