"""Readers and writers: hourly series, payload documents, run rows, traces, summaries."""
