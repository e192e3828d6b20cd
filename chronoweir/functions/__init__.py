"""Column functions and small helpers at the edge of Spark."""
