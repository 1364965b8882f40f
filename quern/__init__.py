"""Offer matching, price analytics and training-data preparation as Spark jobs."""
