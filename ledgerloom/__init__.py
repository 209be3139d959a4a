"""Financial-statement analytics as Spark jobs over many documents at once."""
