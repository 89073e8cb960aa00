"""Training-data operators: packing, joins on shingles, filters, scoring, encoding.

Nothing outside this subpackage imports it.
"""
