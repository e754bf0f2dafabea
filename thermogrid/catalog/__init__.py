"""The registered queries: each names an operator, runs it on the given tables and states its SQL twin."""
