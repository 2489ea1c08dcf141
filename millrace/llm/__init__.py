"""Training-data operators for language-model corpora.

Nothing outside this subpackage imports it.  ``queries.QUERIES`` and
``queries.ORACLES`` hold the registered queries and their SQL.
"""
