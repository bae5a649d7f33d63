"""Readers and writers for datasets, predictions and the event log."""
