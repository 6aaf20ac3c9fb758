"""Note-event analytics on Spark: every operator takes and returns DataFrames keyed by ``track_id``."""
