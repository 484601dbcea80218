"""sparkdoc: queries and processing of JSON document collections on Spark."""
