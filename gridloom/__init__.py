"""A PySpark-native toolkit for messy tables and texts: cleaning, workflows, formulas, extraction, job history."""
