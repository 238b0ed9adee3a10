"""Departure-feed analytics on Spark: waiting times, train progress and train positions."""
