"""Rules over facts, evaluated as Spark plans."""
