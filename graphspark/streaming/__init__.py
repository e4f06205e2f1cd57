"""Structured Streaming jobs over status events and payloads; each is a transformation that runs on batches too."""
