"""Resumable maps: by batches of what is pending, and by Structured Streaming over arriving files."""
