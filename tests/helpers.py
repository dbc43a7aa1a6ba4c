"""What tests share; a module of its own, as each test folder has a conftest."""

from __future__ import annotations


def rows_of(df, *order):
    """Rows as plain tuples, sorted."""
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((v is not None, str(type(v)), v) for v in t))


def by_key(df, *keys):
    """Rows as dicts under their key."""
    out = {}
    for r in df.collect():
        key = tuple(r[k] for k in keys)
        out[key[0] if len(keys) == 1 else key] = r.asDict()
    return out
