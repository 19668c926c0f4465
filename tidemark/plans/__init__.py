"""Helpers that shape how a job runs: staging, partition sizing, sessions."""
