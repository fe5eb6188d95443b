"""Analytics over ordered logs of keyed mutations, on PySpark."""
