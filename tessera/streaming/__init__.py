"""Data quality of streams: states of micro-batches, merged."""
