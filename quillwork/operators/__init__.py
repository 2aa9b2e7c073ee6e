"""DataFrame -> DataFrame operators of the transcript pipeline."""
