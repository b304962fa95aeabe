"""Feature tables from dated field observations, built on Spark DataFrames.

Every public function takes DataFrames and column names and returns a
DataFrame; nothing here collects data to the driver unless its docstring says
so and names the bound.
"""

__version__ = "0.1.0"
