"""Registered repositories, scope settings and changes in git, as the driver reads them."""

from __future__ import annotations

import json
import re
import subprocess
import tomllib
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import skip_names


@dataclass
class Repo:
    name: str
    path: str
    skip: list[str] = field(default_factory=list)
    added_at: datetime | None = None


def parse_line(line: str) -> Repo | None:
    """name|path, then skipped folders and the time it was added, if there; None if a part is not valid. A time that can't be read is unknown."""
    parts = line.rstrip("\n").split("|", 3)
    if len(parts) < 2 or not parts[0].strip() or not parts[1].strip():
        return None
    listed = [x for x in parts[2].split(",") if x.strip()] if len(parts) > 2 else []
    skip = skip_names(listed)
    if len(skip) != len({x.strip() for x in listed}):
        return None
    added = None
    if len(parts) > 3:
        try:
            added = datetime.fromisoformat(parts[3].strip()).astimezone(UTC)
        except ValueError:
            added = None
    return Repo(parts[0].strip(), parts[1].strip(), skip, added)


def parsed(lines: DataFrame) -> DataFrame:
    """lines (line, ...) with name, path, skip and added_unix of each; all null where a line is not valid."""

    @F.pandas_udf("name string, path string, skip array<string>, added_unix long")
    def read(line: pd.Series) -> pd.DataFrame:
        found = [parse_line(x) for x in line]
        return pd.DataFrame([(None, None, None, None) if r is None else (r.name, r.path, r.skip, int(r.added_at.timestamp()) if r.added_at else None) for r in found], columns=["name", "path", "skip", "added_unix"]).astype({"added_unix": "Int64"})

    return lines.withColumn("_repo", read("line")).select(*lines.columns, "_repo.*")


def format_line(repo: Repo) -> str:
    """name|path, and behind it the skipped folders and the time only if there are any; the time is the fourth field."""
    skip = ",".join(skip_names(repo.skip))
    at = [skip, repo.added_at.strftime("%Y-%m-%dT%H:%M:%SZ")] if repo.added_at else [skip] if skip else []
    return "|".join([repo.name, repo.path, *at])


def load(path: str) -> list[Repo]:
    file = Path(path)
    return [r for r in map(parse_line, file.read_text().split("\n")) if r] if file.exists() else []


def save(path: str, repos: list[Repo]) -> None:
    Path(path).write_text("".join(format_line(r) + "\n" for r in repos))


def read_scope(path: str) -> tuple[list[str], dict[str, float], dict[str, int]] | None:
    """(scope, weights, limits) of a TOML file, None if it isn't there."""
    file = Path(path)
    if not file.exists():
        return None
    got = tomllib.loads(file.read_text())
    return list(got.get("scope", [])), dict(got.get("weights", {})), dict(got.get("limits", {}))


def project_repositories(text: str) -> list[str]:
    """The names of a YAML file's list of repositories."""
    out, inside = [], False
    for line in text.split("\n"):
        if re.match(r"^repositories:\s*$", line):
            inside = True
        elif inside and (m := re.match(r"^\s*-\s+(.+?)\s*$", line)):
            out.append(m[1].strip("'\""))
        elif line.strip() and not line.startswith((" ", "\t", "-", "#")):
            inside = False
    return out


def render_project(names: list[str]) -> str:
    return "repositories:\n" + "".join(f"  - {n}\n" for n in names)


class GitError(RuntimeError):
    pass


def changed_files(root: str, last: str | None, types: tuple[str, ...] = ("md", "mdx", "txt")) -> tuple[list[str], str | None]:
    """(paths, head): what git has changed since last, with renames as two files, and in the work tree; all tracked files if last is None. ([], None) where there is no commit; a git that fails otherwise is an error, not an empty answer: GitError."""

    def git(*args: str) -> list[str]:
        got = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=60)
        if got.returncode:
            raise GitError(f"git {args[0]}: {got.stderr.strip()}")
        return [x for x in got.stdout.split("\0") if x]

    try:
        head = git("rev-parse", "--verify", "HEAD")[0].strip()
    except GitError:
        return [], None
    names = set(git("ls-files", "-z")) if not last else set(git("diff", "--name-only", "--no-renames", "-z", last, head)) if last != head else set()
    names |= set(git("diff", "--name-only", "--no-renames", "-z")) | set(git("diff", "--cached", "--name-only", "--no-renames", "-z")) | set(git("ls-files", "--others", "--exclude-standard", "-z"))
    return sorted(n for n in names if n.rpartition(".")[2].lower() in types), head


def lock_name(repo: str) -> str:
    """The name of a repo's lock file, which is one segment of a path whatever the repo's name holds."""
    return repo.replace("/", "_").replace("\\", "_") + ".lock"


def quoted(argument: str) -> str:
    """An argument in single quotes, safe in a shell's line."""
    return "'" + argument.replace("'", "'\\''") + "'"


@dataclass
class ExternalGraph:
    name: str
    path: str
    kind: str = "graphify"
    mtime: int = 0
    n_nodes: int = 0
    added_at: int = 0


def load_graphs(path: str) -> dict[str, ExternalGraph]:
    """Graphs registered by hand, by name, from a file of one JSON object a line."""
    file = Path(path)
    found = [ExternalGraph(**json.loads(x)) for x in file.read_text().splitlines() if x.strip()] if file.exists() else []
    return {g.name: g for g in sorted(found, key=lambda g: g.name)}


def save_graphs(path: str, graphs: dict[str, ExternalGraph]) -> None:
    Path(path).write_text("".join(json.dumps(asdict(graphs[name])) + "\n" for name in sorted(graphs)))


def add_graph(graphs: dict[str, ExternalGraph], graph: ExternalGraph) -> None:
    if graph.name in graphs:
        raise ValueError(f"a graph is named {graph.name} already")
    if graph.kind not in ("graphify", "code-review-graph"):
        raise ValueError(f"no kind of graph: {graph.kind}")
    graphs[graph.name] = graph


def remove_graph(graphs: dict[str, ExternalGraph], name: str) -> None:
    """A KeyError for a name that isn't registered."""
    del graphs[name]


def prune_graphs(graphs: dict[str, ExternalGraph]) -> list[str]:
    """Takes out the graphs whose file is gone; their names."""
    gone = [name for name, g in graphs.items() if not Path(g.path).exists()]
    for name in gone:
        del graphs[name]
    return gone
