"""PySpark-native Bayesian regression on sparse coded matrices."""
