"""DataFrame operators of local differential privacy."""
