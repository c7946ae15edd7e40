"""From rules to Spark plans."""
