"""Training-data operators over transcripts; nothing else in the library imports this package."""
