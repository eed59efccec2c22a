"""Combat-log analytics for Spark: log lines in, typed events and tables out."""
