"""DataFrame operators of retrieval, ranking and evaluation."""
