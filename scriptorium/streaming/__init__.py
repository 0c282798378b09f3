"""Structured Streaming plans: file sources, watermarks, deduplication, quarantine, state."""
