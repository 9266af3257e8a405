"""Judging results: comparison, fingerprints and roll-up reports."""
