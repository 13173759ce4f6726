"""Operators that prepare text for the training of language models.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it is present.
"""
