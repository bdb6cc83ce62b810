"""Walkthrough analytics on Spark: recordings, transcripts and analyses as tables, and the operators over them."""
