"""DataFrame operators: chunking, retrieval, reranking, memory, ingestion and evaluation."""
