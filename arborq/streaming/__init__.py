"""Structured Streaming: JSON documents that arrive in chunks, as node patches and snapshots."""

from arborq.streaming.chunks import batch_patches, latest_snapshots, patches, split_chunks

__all__ = ["batch_patches", "latest_snapshots", "patches", "split_chunks"]
