"""Operators for training-data pipelines.

Nothing outside this package imports it. ``queries`` holds the registered
queries; every other module holds one operator and can be used by itself.
"""
