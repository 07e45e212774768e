"""Live maintenance of the index with Structured Streaming."""
