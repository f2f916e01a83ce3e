"""Which repositories a query is for, and how it runs: decided on the driver before any plan is built."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from ..operators.rank import LIMITS, WEIGHTS

GRAPH = "graph:"


@dataclass
class Plan:
    repos: list[str]
    source: str  # fts, graph or both
    rank: str  # bm25 or graph-aware
    notes: list[str] = field(default_factory=list)

    @property
    def runs_fts(self) -> bool:
        return self.source in ("fts", "both")

    @property
    def runs_graph(self) -> bool:
        return self.source in ("graph", "both")


def search_plan(registered: list[str], with_graph: list[str], repo: str | None = None, repos: str = "all", source: str = "auto", rank: str = "auto") -> Plan:
    """A repo named alone goes before a list; auto takes both sources and centrality if any chosen repo has a graph."""
    notes: list[str] = []
    if repo:
        chosen = [repo]
    elif repos == "all":
        chosen = list(registered)
    elif repos == "graph-only":
        chosen = [r for r in registered if r in with_graph]
    else:
        wanted = [r.strip() for r in repos.split(",") if r.strip()]
        chosen = [r for r in wanted if r in registered]
        notes += [f"not registered: {r}" for r in wanted if r not in registered]
    graphs = [r for r in chosen if r in with_graph]
    if source not in ("auto", "fts", "graph", "both") or rank not in ("auto", "bm25", "graph-aware"):
        raise ValueError(f"source {source}, rank {rank}")
    return Plan(chosen, source if source != "auto" else "both" if graphs else "fts", rank if rank != "auto" else "graph-aware" if graphs else "bm25", notes)


def partition(entries: list[str]) -> tuple[list[str], list[str]]:
    """(repos, graphs): entries that begin with graph: are graphs; order stays."""
    return [e for e in entries if not e.startswith(GRAPH)], [e.removeprefix(GRAPH) for e in entries if e.startswith(GRAPH)]


def kept(names: list[str], registered: list[str]) -> list[str]:
    return [n for n in names if n in registered]


def nearest_repo(cwd: str, repos: dict[str, str]) -> str | None:
    """The repo of the longest path that is cwd or above it."""
    at = os.path.normpath(cwd)
    above = [(len(os.path.normpath(p)), n) for n, p in repos.items() if at == os.path.normpath(p) or at.startswith(os.path.normpath(p).rstrip("/") + "/")]
    return max(above)[1] if above else None


@dataclass
class Scope:
    entries: list[str]
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    limits: dict[str, int] = field(default_factory=lambda: dict(LIMITS))
    origin: str = "flag"


def resolve(flag: list[str] | None, cwd: str, home: str, repos: dict[str, str], name: str = "scope.toml") -> Scope:
    """The flag, else the project's file in cwd or above, else the one at home, else the repo that cwd is in."""
    from ..sources.registry import read_scope

    if flag:
        return Scope(flag)
    at, seen = os.path.normpath(cwd), []
    while at not in seen:
        seen.append(at)
        at = os.path.dirname(at)
    for folder, origin in (*((x, "project") for x in seen), (home, "home")):
        got = read_scope(f"{folder}/{name}")
        if got and got[0]:
            return Scope(got[0], WEIGHTS | got[1], LIMITS | got[2], origin)
    near = nearest_repo(cwd, repos)
    if near is None:
        raise ValueError("no scope: name one, write a scope file or go to a registered repository")
    return Scope([near], origin="cwd")


def scan_target(argument: str | None, cwd: str, repos: dict[str, str]) -> tuple[str, list[str]]:
    """(mode, repos): all rebuilds everything, a name that repo, nothing the repo that cwd is in; decided before anything is changed."""
    if argument == "all":
        return "full", list(repos)
    if argument:
        if argument not in repos:
            raise ValueError(f"not registered: {argument}")
        return "one", [argument]
    near = nearest_repo(cwd, repos)
    if near is None:
        raise ValueError("not in a registered repository")
    return "one", [near]
