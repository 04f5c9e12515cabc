"""Market analytics on Spark: declarative operators over bars, fundamentals, ticks and text."""
