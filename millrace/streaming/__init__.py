"""Stream operators on Structured Streaming sources."""
