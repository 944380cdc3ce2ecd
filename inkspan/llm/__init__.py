"""Training-data operators. Nothing outside this subpackage imports it except the
registry in ``__spark_entry__.py``, which works without it."""
