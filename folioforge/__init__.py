"""folioforge: document-structure analytics expressed as Spark DataFrames."""
