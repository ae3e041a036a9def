"""DataFrame operators: chunking, embedding, ids, shards, dedup, search, reports."""
