"""Readers and writers for JSON documents, JSONL logs and write-ahead logs."""
