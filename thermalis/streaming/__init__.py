"""The live path on Structured Streaming."""
