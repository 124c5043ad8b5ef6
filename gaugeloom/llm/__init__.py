"""Training-data operators: extraction, archives, fingerprints, filters, joins and mixing.

Nothing outside this subpackage imports it; its queries are listed in ``queries.py``.
"""
