"""Training-data operators over text tables: one module per operator.

Nothing outside this subpackage imports it. ``queries`` registers the thin
``opN_<name>`` queries, ``oracles`` the DuckDB SQL of those that SQL can express.
"""
