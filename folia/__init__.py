"""folia: PDF corpora as Spark tables, with Column-level geometry, layout and authoring."""

__version__ = "0.1.0"
