"""Training-data operators. Nothing outside this subpackage (and the optional hook in __spark_entry__) imports it."""
