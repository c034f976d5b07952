"""Privacy analytics over text, Spark first."""
