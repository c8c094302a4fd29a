"""sitegauge: website-audit analytics as Spark DataFrame jobs."""
