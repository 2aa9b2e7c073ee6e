"""Resumable batches and streamed results."""
