"""Training-data operators: ten operators on documents and pages, their queries and SQL.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its queries when it is there.
"""
