"""Operations of a large-scale training-data pipeline, as Spark jobs.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its general interface; ``queries`` holds the registered queries
and their SQL.
"""
