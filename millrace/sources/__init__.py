"""Readers: webhook payloads, log batches, readings, uploaded documents."""
