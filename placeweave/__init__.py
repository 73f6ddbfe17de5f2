"""placeweave: point-of-interest and trip data as Spark DataFrame jobs."""
