"""Market analytics over (symbol, ts) panels, expressed as Spark DataFrame operators."""
