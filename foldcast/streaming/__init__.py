"""The learnt transformations and scores on Structured Streaming."""
