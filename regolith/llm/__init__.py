"""Training-data operators: every public function takes and returns DataFrames.

Nothing outside this subpackage imports it.
"""
