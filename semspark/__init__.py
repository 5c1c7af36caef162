"""Evaluation of generated text, and training-data operators, on Spark."""
