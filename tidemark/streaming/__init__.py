"""Structured Streaming forms of the session ledger, chunking and the trace sink."""
