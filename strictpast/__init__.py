"""Point-in-time entity-date panels and factors, expressed as Spark DataFrame jobs."""
