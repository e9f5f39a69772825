"""Structured Streaming: receipts and statements matched as they arrive."""
