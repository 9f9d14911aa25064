"""Spark operators for judging one sparse count dataset against another.

Every operator takes DataFrames and returns a DataFrame.  Grouping keys are an
argument (``by``), so many datasets are scored inside one Spark plan.
"""
