"""Operators that prepare large training corpora of transcripts and texts. Nothing outside imports this package."""
