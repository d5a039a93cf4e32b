"""Operators that prepare text and vectors for training language models.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries if it is there.
"""
