"""Structured Streaming: the stateless transforms over micro-batches, each written once."""

from citeweave.plans.engine import cancel_stream, process_stream

__all__ = ["cancel_stream", "process_stream"]
