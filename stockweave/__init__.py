"""stockweave: demand-panel analytics on PySpark, plus corpus operators in the optional ``llm`` subpackage."""
