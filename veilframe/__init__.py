"""veilframe: anonymise person-level tables with Spark and measure the result."""
