"""Retail sales analytics and demand planning as Spark jobs."""
