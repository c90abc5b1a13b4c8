"""Readers and writers of logs, label batches, frames and checkpoint lists."""
