"""Operators for preparing large training corpora, each one a Spark job.

Nothing outside this folder imports it.
"""
