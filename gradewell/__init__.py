"""gradewell: a Spark-first engine for measurement-based grading and its evaluation."""

__version__ = "0.1.0"
