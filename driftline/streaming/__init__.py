"""Structured Streaming: intake, lateness, pairing, masks, throttling."""
