"""Structured Streaming forms of the detectors. Event time, with an explicit watermark."""
