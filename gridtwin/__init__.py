"""Paired evaluation corpora as Spark DataFrames.

Every public function takes and returns DataFrames or Columns, so the pieces
compose with ordinary Spark code.
"""

VERSION = "1.0.0"
