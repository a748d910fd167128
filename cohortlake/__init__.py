"""Feature-matrix analytics over entity hierarchies, on Spark."""
