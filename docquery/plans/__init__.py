"""From a query string to a Spark predicate."""
