"""Extension: the batch ingest, run for each micro-batch of a stream."""
