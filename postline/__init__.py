"""Posting-feed analytics on PySpark: snapshot diffs, labels, registries, listings and digests."""
