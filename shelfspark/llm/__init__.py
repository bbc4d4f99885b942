"""Training-data operators for document tables; nothing outside this package imports it."""
