"""Assembly-error analytics as Spark DataFrame operators."""
