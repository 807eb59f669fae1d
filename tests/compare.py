"""Rows of a result in a stable order; a module of its own name, which no other conftest can hide."""


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
