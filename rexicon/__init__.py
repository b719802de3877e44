"""rexicon: regular-expression search over text corpora on PySpark."""
