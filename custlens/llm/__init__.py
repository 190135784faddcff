"""Operators for preparing language-model training data, as Spark jobs.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` registers its queries when
the subpackage is present.
"""
