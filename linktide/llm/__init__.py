"""Operators for preparing training text.

Each module holds one operator; ``queries`` registers them over the given
tables. Common conventions: a null text counts as empty, a null id never equals
another id, an input column that carries the name of an output column is
replaced (whatever its case), names that begin with two underscores are
reserved, and an empty table gives an empty result with the same schema.
"""
