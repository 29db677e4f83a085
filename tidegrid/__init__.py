"""Availability analytics for networks of fixed stations, as DataFrame functions on Spark."""
