"""Column expressions. Nothing here needs a SparkSession or runs Python per row."""
