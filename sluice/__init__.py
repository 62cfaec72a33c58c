"""sluice: source text, configuration and corpora as queryable Spark DataFrames."""
