"""Image-dataset analytics as Spark DataFrame plans."""
