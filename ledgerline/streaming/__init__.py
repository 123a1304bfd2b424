"""Structured Streaming forms of the cleanup.

The reference has no streams (no watermark, window or state); the only
stream-shaped need is raw order dumps that keep arriving. ``raw_orders``
runs the same S1 + D1 work (declared-schema CSV, typed timestamps with
quarantine) on each new file set, with no operator of its own.
"""
