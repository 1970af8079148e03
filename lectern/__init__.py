"""lectern: document extraction, text quality and reading analytics on PySpark."""
