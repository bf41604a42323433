"""A search-and-facet engine over flat files, as Spark DataFrame plans."""
