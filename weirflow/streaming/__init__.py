"""The same verbs on Structured Streaming."""
