"""Keyed state folds used by batch and Structured Streaming alike."""
