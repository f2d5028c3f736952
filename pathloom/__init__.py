"""Semantic-trajectory analytics and training-data operators on Spark."""
