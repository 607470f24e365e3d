"""Live queries and notifications on Structured Streaming."""
