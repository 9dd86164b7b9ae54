"""DataFrame operators on lines, events, batches and frames."""
