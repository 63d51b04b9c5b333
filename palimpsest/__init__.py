"""Comparison of versioned collections on Spark.

Two versions of a document, drawing, model or table are paired, their members given a
position-independent identity, aligned, classified as added, deleted, modified or
unchanged, scored, and committed under a content-addressed key. All of it is DataFrame
expressions and joins, with grouped Arrow kernels only for order-dependent alignment.
"""
