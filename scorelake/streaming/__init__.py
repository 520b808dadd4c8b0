"""Structured Streaming: ticks, bounded state, sentences, sessions."""
