"""Review-evidence analytics and corpus preparation as plain Spark plans."""
