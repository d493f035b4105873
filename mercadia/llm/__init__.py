"""Training-data operators: ten large-scale corpus operations, each a Spark job of its own."""
