"""Sales analytics and demand forecasting as Spark jobs."""
