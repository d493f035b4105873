"""What is worked out about a query before any data is read."""
