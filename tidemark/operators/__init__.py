"""Operators over bars, votes, texts and manifests."""
