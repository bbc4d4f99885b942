"""All queries of this package by name, with their SQL."""

from __future__ import annotations

from . import agents, checks, fusion, ingest, link, names, queue, requests, similar, state, timeline, trees


def _all() -> dict[str, tuple]:
    out: dict[str, tuple] = {}
    for module in (link, similar, names, fusion, timeline, trees, queue, state, ingest, requests, agents, checks):
        out.update(module.QUERIES)
    return out


def queries() -> dict:
    return {k: f for k, (f, _) in _all().items()}


def oracles() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _all().items() if sql}
