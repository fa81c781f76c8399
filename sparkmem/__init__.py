"""sparkmem: memory retrieval and knowledge-graph analytics on PySpark."""
