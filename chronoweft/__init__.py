"""Analytics over timed, nested records on PySpark."""
