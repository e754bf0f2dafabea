"""Live observations with Structured Streaming. Every transformation also runs on a static table."""
