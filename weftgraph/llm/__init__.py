"""Operators for preparing large training corpora with Spark.

Each module holds one operator with its own general interface; ``queries``
applies them to the tables of the test data with production parameters.
"""
