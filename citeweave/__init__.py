"""citeweave: quotation matching and canonicalisation over Spark DataFrames."""
