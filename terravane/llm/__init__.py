"""Training-data operators: WARC, quality rules, licences, images, shards, joins, tokens, packing, lines.

Nothing outside this subpackage imports it.
"""
