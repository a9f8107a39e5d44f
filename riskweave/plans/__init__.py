"""Composed plans: fixtures -> features -> scores, the query catalog and the
SQL oracle texts used to check it."""
