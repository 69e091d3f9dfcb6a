"""Readers, encoders and samplers of user tables."""
