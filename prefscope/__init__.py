"""prefscope: Spark jobs for preference data and model evaluation.

functions/  Column -> Column text, chat and rule functions
operators/  DataFrame -> DataFrame filters, samples, scoring, log-probs, judging, reports
sources/    readers and writers with explicit schemas
plans/      fixtures over the test tables, registered queries, DuckDB oracles
streaming/  the same operators over arriving files
"""

__version__ = "0.1.0"
