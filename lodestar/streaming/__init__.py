"""Log processing, batch and Structured Streaming."""
