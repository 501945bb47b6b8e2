"""Operators that prepare project text for language-model training.

They work on the project's own records: verbatim entries (``entry_id``, ``exact_text``), evidence
(``evidence_id``, ``source_locator``, ``extraction``), review items (``item_id``, ``source_text``),
raw artifacts and trial items. ``queries`` maps the given tables to these records and back.
"""
