"""DataFrame operators; each module states its null, empty and tie behaviour in its docstrings."""
