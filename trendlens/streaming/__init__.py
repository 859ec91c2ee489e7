"""Incremental ingestion of daily snapshot files (Structured Streaming)."""

from trendlens.streaming.snapshots import (RAW_SCHEMA, compact_snapshots, replace_batch, stream_clean_snapshots,
                                           stream_clean_table)

__all__ = ["RAW_SCHEMA", "compact_snapshots", "replace_batch", "stream_clean_snapshots", "stream_clean_table"]
