"""Incremental forms: resumable batches and keep-last upserts."""
