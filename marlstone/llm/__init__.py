"""Operators for building language-model training data.

Nothing outside this folder (but the pipeline script and the driver's entry
file) imports it, so it can be removed without touching the SQL engine.
"""
