"""Spark-native analytics for irregular time series and the tables around them."""
