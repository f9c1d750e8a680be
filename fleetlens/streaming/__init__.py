"""Job state in batch and Structured Streaming form."""
