"""ledgerline: PySpark analytics for e-commerce order data.

Cleaning (typed casts, keep-last de-duplication, key and reference checks,
reference-data repair) and a set of parameterised business analyses, all
expressed with the DataFrame API so Catalyst plans and distributes them.
"""

__version__ = "0.1.0"
