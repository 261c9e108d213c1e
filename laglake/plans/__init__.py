"""Series views over the driver tables and the registered queries built on the operators."""
