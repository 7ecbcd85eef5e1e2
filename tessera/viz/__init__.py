"""Charts from YAML: data preparation in Spark, code generation, and rendering as HTML or SVG."""
