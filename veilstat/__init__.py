"""Local-differential-privacy analytics as Spark DataFrame plans."""
