"""terrasift: Spark-native analytics for geospatial case planning and evaluation."""
