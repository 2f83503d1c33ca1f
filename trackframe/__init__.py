"""trackframe: trajectory analytics over detection tables, as Spark plans."""
