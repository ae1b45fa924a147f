"""Payload analytics on Spark: captures, alerts, byte grams, sketches, statistics."""
