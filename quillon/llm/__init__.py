"""Operators for preparing training corpora: deduplication, filtering, tokenising, decontamination.

Nothing else in the library imports this subpackage.  Every module holds one operator with a
general interface; ``queries`` binds them to the tables of the test corpus.
"""
