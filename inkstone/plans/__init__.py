"""Index, retrieval, rewriting and answers as logical plans."""
