"""DataFrame operators; use them with ``df.transform(operator, ...)``."""
