"""Configuration, manifests and workspaces: small documents, read on the driver."""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field
from pathlib import Path

#: Fixed values.
NAMES = ("tessera.jsonc", "tessera.json")
MARKERS = (".git", "pnpm-workspace.yaml", "turbo.json", "nx.json", "lerna.json", "go.work", ".tessera-workspace")
LOCKS = (("pnpm-lock.yaml", "pnpm"), ("yarn.lock", "yarn"), ("bun.lockb", "bun"), ("bun.lock", "bun"), ("package-lock.json", "npm"))
RESERVED = ("core", "tessera", "_", "framework:hint")
HINTS = "config-hints"


class BadConfig(ValueError):
    pass


def strip_comments(text: str) -> str:
    """JSON with comments and trailing commas as JSON; strings stay as they are."""
    out, i, n = [], 0, len(text)
    while i < n:
        if text[i] == '"':
            j = i + 1
            while j < n and text[j] != '"':
                j += 2 if text[j] == "\\" else 1
            out.append(text[i : j + 1])
            i = j + 1
        elif text.startswith("//", i):
            i = text.find("\n", i) if "\n" in text[i:] else n
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            if end < 0:
                raise BadConfig("a comment does not end")
            i = end + 2
        else:
            out.append(text[i])
            i += 1
    parts = re.split(r'("(?:[^"\\]|\\.)*")', "".join(out))
    return "".join(p if k % 2 else re.sub(r",(\s*[}\]])", r"\1", p) for k, p in enumerate(parts))


@dataclass
class Config:
    ignore: list[str] = field(default_factory=list)
    components: list[dict] = field(default_factory=list)
    plugins: dict[str, list[str]] = field(default_factory=dict)
    languages: list[str] = field(default_factory=list)
    frameworks: list[str] = field(default_factory=list)
    effects: list[str] = field(default_factory=list)
    plugin_options: dict = field(default_factory=dict)
    suppress: list[str] = field(default_factory=list)
    #: Prefixes of calls that are never dropped.
    keep: list[str] = field(default_factory=list)
    gitignore: bool = True
    #: Whether vocabulary that no plugin declares is an error, or only told.
    strict: bool = True
    output: dict = field(default_factory=dict)
    framework_hints: list[dict] = field(default_factory=list)
    min_parsed_ratio: float = 0.0
    max_file_bytes: int = 2 * 1024 * 1024
    line_window: int = 2


FIELDS = {
    "ignore": list, "components": list, "plugins": dict, "languages": list, "frameworks": list, "effects": list, "pluginOptions": dict, "suppress": list, "keep": list, "respectGitignore": bool, "strict": bool, "output": dict,
    "frameworkHints": list, "minParsedFileRatio": (int, float), "maxFileSizeBytes": int, "lineFuzz": int,
}
#: Fields that set limits of time or a language server, which this engine does not have; they are read and have no effect.
IDLE = ("$schema", "parseTimeoutMs", "classifyTimeoutMs", "lsp")
TO = {"pluginOptions": "plugin_options", "respectGitignore": "gitignore", "frameworkHints": "framework_hints", "minParsedFileRatio": "min_parsed_ratio", "maxFileSizeBytes": "max_file_bytes", "lineFuzz": "line_window"}


def parse(text: str, where: str = "config") -> Config:
    try:
        raw = json.loads(strip_comments(text))
    except json.JSONDecodeError as e:
        raise BadConfig(f"{where}: {e}") from e
    if not isinstance(raw, dict):
        raise BadConfig(f"{where}: not an object")
    out = Config()
    for key, value in raw.items():
        if key in IDLE:
            continue
        if key not in FIELDS or isinstance(value, bool) != (FIELDS[key] is bool) or not isinstance(value, FIELDS[key]):
            raise BadConfig(f"{where}: {key} is unknown or of another kind")
        setattr(out, TO.get(key, key), value)
    for name, rows, key in (("components", out.components, "id"), ("frameworkHints", out.framework_hints, "name")):
        again = [k for k, n in Counter(r.get(key) for r in rows).items() if n > 1]
        if again:
            raise BadConfig(f"{where}: {name} has {again[0]!r} twice")
    if not 0 <= out.line_window <= 10:
        raise BadConfig(f"{where}: lineFuzz lies between 0 and 10")
    return out


def rendered(components: list[dict]) -> tuple[str, dict[str, list[str]]]:
    """A configuration's text for detected components, and what they use that nothing built in reads or classifies.
    TypeScript and JavaScript and the built-in frameworks need no plugin, so none is named."""
    fields = ("id", "name", "roots", "languages", "frameworks")
    rows = [{k: (sorted(c.get(k) or []) if k not in ("id", "name") else c[k]) for k in fields} for c in components]
    used = {k: {v for c in rows for v in c[k]} for k in ("languages", "frameworks")}
    known = {"languages": {"ts", "tsx", "js", "jsx"}, "frameworks": {"nestjs", "nextjs", "react", "express"}}
    body = {"languages": [], "frameworks": [], "effects": [], "components": [{k: r[k] for k in ("id", "name", "roots")} for r in rows]}
    return json.dumps(body, indent=2, ensure_ascii=False) + "\n", {k: sorted(used[k] - known[k]) for k in used}


def find(start: str | Path) -> Path | None:
    """The nearest configuration file at or above `start`."""
    for folder in (Path(start), *Path(start).parents):
        for name in NAMES:
            if (folder / name).is_file():
                return folder / name
    return None


def load(start: str | Path) -> Config:
    path = find(start)
    return Config() if path is None else parse(path.read_text(encoding="utf-8"), str(path))


def is_root(folder: Path) -> bool:
    if any((folder / m).exists() for m in MARKERS):
        return True
    read = lambda n: (folder / n).read_text(encoding="utf-8", errors="replace") if (folder / n).is_file() else ""
    package = read("package.json")
    return ('"workspaces"' in package) or bool(re.search(r"(?m)^\[workspace\]", read("Cargo.toml"))) or bool(re.search(r"(?m)^\[tool\.(uv|hatch|poetry)", read("pyproject.toml")))


def workspace_root(start: str | Path) -> Path | None:
    """The outermost folder at or above `start` that holds a marker."""
    hits = [f for f in (Path(start), *Path(start).parents) if is_root(f)]
    return hits[-1] if hits else None


def managers(root: str | Path) -> list[dict]:
    """(tool, manifest, patterns) by tool."""
    root, out = Path(root), []
    if (root / "pnpm-workspace.yaml").is_file():
        text = (root / "pnpm-workspace.yaml").read_text(encoding="utf-8")
        block = re.search(r"(?m)^packages:\s*\n((?:[ \t]+-.*\n?|[ \t]*#.*\n|\s*\n)*)", text)
        found = re.findall(r"(?m)^[ \t]+-[ \t]*['\"]?([^'\"#\n]+?)['\"]?[ \t]*(?:#.*)?$", block[1]) if block else []
        out.append({"tool": "pnpm", "manifest": "pnpm-workspace.yaml", "patterns": found})
    if (root / "package.json").is_file():
        try:
            spaces = json.loads((root / "package.json").read_text(encoding="utf-8")).get("workspaces")
        except (json.JSONDecodeError, AttributeError) as e:
            raise BadConfig(f"package.json: {e}") from e
        spaces = spaces.get("packages") if isinstance(spaces, dict) else spaces
        if spaces:
            tool = next((t for name, t in LOCKS if (root / name).exists()), "npm")
            if not any(m["tool"] == tool for m in out):
                out.append({"tool": tool, "manifest": "package.json", "patterns": list(spaces)})
    for name, tool in (("turbo.json", "turbo"), ("nx.json", "nx")):
        if (root / name).is_file():
            out.append({"tool": tool, "manifest": name, "patterns": []})
    return sorted(out, key=lambda m: m["tool"])


def public_api(package: dict) -> list[str]:
    """Files that a package names as its entries."""
    found: set[str] = set()

    def walk(v) -> None:
        if isinstance(v, str):
            p = unicodedata.normalize("NFC", v.removeprefix("./"))
            if p and "\\" not in p:
                found.add(p)
        elif isinstance(v, dict):
            for x in v.values():
                walk(x)
        elif isinstance(v, list):
            for x in v:
                walk(x)

    for key in ("exports", "main", "module", "types", "typings"):
        walk(package.get(key))
    return sorted(found)


def frameworks(package: dict) -> list[str]:
    from ..operators.classify import FRAMEWORKS

    names = {n for block in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies") for n in package.get(block) or {}}
    return sorted({FRAMEWORKS[n] for n in names if n in FRAMEWORKS})


class Registry:
    """Vocabulary of plugins: exact ids and prefixes, each with one owner. Clashes have codes."""

    def __init__(self):
        self.ids: dict[tuple[str, str], str] = {}
        self.prefixes: dict[tuple[str, str], str] = {}
        self.names: set[str] = set()

    def register(self, manifest: dict) -> None:
        name = manifest["name"]
        if name in self.names:
            raise BadConfig(f"plugin-name: {name} twice")
        provides = manifest.get("provides", {})
        new_ids, new_prefixes = {}, {}
        for space in ("effects", "extKinds", "derivedBy"):
            for v in provides.get(space, []):
                key = (space, v)
                if name != HINTS and (v.split(":")[0] in RESERVED or any(v == r or v.startswith(r + ":") for r in RESERVED)):
                    raise BadConfig(f"reserved: {v}")
                if key in self.ids or key in new_ids:
                    raise BadConfig(f"duplicate-id: {v}")
                if (owner := self.owner(space, v)) and owner != name:
                    raise BadConfig(f"shadowing: {v} lies in a prefix of {owner}")
                new_ids[key] = name
            for p in provides.get(f"{space}Prefixes", []):
                for (s, q), owner in {**self.prefixes, **new_prefixes}.items():
                    if s == space and p == q:
                        raise BadConfig(f"duplicate-prefix: {p}")
                    if s == space and (p.startswith(q + ":") or q.startswith(p + ":")) and owner != name:
                        raise BadConfig(f"prefix-overlap: {p} and {q}")
                if p in RESERVED or p.split(":")[0] in RESERVED:
                    raise BadConfig(f"reserved: {p}")
                if space == "effects" and not p.startswith("x-"):
                    raise BadConfig(f"x-prefix: {p}")
                new_prefixes[(space, p)] = name
        self.names.add(name)
        self.ids |= new_ids
        self.prefixes |= new_prefixes

    def owner(self, space: str, v: str) -> str | None:
        """Who declared v, by id or by the longest prefix."""
        if (space, v) in self.ids:
            return self.ids[(space, v)]
        hits = [(len(p), owner) for (s, p), owner in self.prefixes.items() if s == space and (v == p or v.startswith(p + ":"))]
        return max(hits)[1] if hits else None


def hint_manifest(hints: list[dict]) -> dict | None:
    """A manifest for the vocabulary of configured hints; a hint's tags live below framework:hint."""
    if not hints:
        return None
    tag = lambda h: "framework:hint:" + h["name"].removeprefix("framework:")
    return {"name": HINTS, "version": "0", "type": "framework", "provides": {"extKinds": sorted(map(tag, hints)), "derivedBy": sorted(map(tag, hints))}}
