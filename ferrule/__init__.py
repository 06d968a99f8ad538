"""ferrule: a Spark-first analytics engine with the semantics of a compact embedded SQL dialect."""
