"""Training-data pipeline operators (dedup, archive, quality, mixing, tokenising).

One module per operator; :mod:`riskfold.llm.catalog` holds the registered
queries and their SQL.  Nothing else in the library imports this subpackage.
"""
