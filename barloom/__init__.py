"""barloom: panel time-series analytics for daily market bars, on PySpark."""
