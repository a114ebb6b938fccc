"""Job event streams in batch and as Structured Streaming."""
