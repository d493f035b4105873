"""Offer comparison on PySpark: landed search payloads in, ranked and compared offers out."""
