"""Session-structured time-series and array analytics expressed as Spark plans."""
