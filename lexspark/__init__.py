"""Spark jobs for collections of court judgments and legal acts."""
