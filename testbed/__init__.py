"""The jobs' inputs derived from the driver's tables, in Spark and in SQL."""
