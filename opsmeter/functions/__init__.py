"""SQL expressions shared by the jobs.

Each helper takes SQL text and returns SQL text, for ``expr``, ``selectExpr`` and
``spark.sql``. All of them are built-in expressions and stay inside codegen.
"""
