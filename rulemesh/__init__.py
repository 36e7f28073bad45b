"""URL rewrite-rule analytics as Spark jobs."""
