"""Terralens: location-grounded question datasets on Spark."""
