"""Training-data operators: each module holds one operator and can be used by itself."""
