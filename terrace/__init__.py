"""terrace: nested columnar tables, cascading filters and keyed layers on PySpark."""
