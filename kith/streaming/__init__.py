"""Chunked loads as Structured Streaming: each input row is indexed or logged exactly once."""

from kith.streaming.ingest import read_stream, stream_index, stream_log

__all__ = ["read_stream", "stream_index", "stream_log"]
