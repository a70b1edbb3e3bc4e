"""parley: sales-meeting analytics as Spark DataFrame jobs.

Every public function takes and returns DataFrames (or Columns for the
expression helpers in ``parley.functions``); nothing collects rows to the
driver except bounded lookups that say so in their docstrings.
"""

__all__ = ["session", "schemas", "fixtures"]
