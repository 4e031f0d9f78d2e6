"""Whole stages and experiments, put together from operators."""
