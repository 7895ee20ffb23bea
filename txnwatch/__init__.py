"""Transaction monitoring as plain DataFrame -> DataFrame operators on Spark."""
