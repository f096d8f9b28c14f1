"""Operators for preparing training data, each as a Spark job over whole tables."""
