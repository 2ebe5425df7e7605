"""Study-content and assessment analytics as Spark DataFrame programs."""
