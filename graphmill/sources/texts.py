"""Parsers of text sources: git logs and blame, configuration files, C includes and macros, compile commands.

The parsers are plain functions over one text, so they are tested without Spark; `parsed` runs any of them
over a column of texts in Arrow batches, each text by itself, wherever its partition is."""

from __future__ import annotations

import json
import re
import shlex
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def parsed(df: DataFrame, parse: Callable[..., Iterable[dict]], columns: list[str], keep: list[str], schema: str) -> DataFrame:
    """keep and the fields of schema for every row that parse(*columns) gives."""
    own = df.select(*dict.fromkeys([*keep, *columns]))
    fields = T.StructType([*(own.schema[k] for k in keep), *T.StructType.fromDDL(schema)])
    names = [f.name for f in T.StructType.fromDDL(schema)]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(fields)
        for b in batches:
            out = []
            for row in b.to_pylist():
                for r in parse(*(row[c] for c in columns)):
                    out.append({**{k: row[k] for k in keep}, **{n: r.get(n) for n in names}})
            yield pa.RecordBatch.from_pylist(out, schema=target)

    return own.mapInArrow(run, fields)


COMMIT = "COMMIT_SEP"


def git_log(text: str | None) -> list[dict]:
    """Commits of `git log --numstat` in the block format: separator, sha, author, email, epoch, parents and
    subject each on a line, then insertions, deletions and path by tabs; `-` for binary files."""
    out = []
    for block in (text or "").split(COMMIT + "\n")[1:]:
        lines = block.split("\n")
        if len(lines) < 6:
            continue
        sha, author, email, when, parents, subject = lines[:6]
        files = []
        for line in lines[6:]:
            part = line.split("\t", 2)
            if len(part) == 3:
                number = [None if x == "-" else int(x) for x in part[:2]]
                kind = "renamed" if " => " in part[2] else "modified"
                files.append({"file_path": part[2], "change_type": kind, "insertions": number[0], "deletions": number[1]})
        out.append({"sha": sha, "author": author, "author_email": email, "timestamp": int(when), "message": subject, "parents": json.dumps(parents.split()), "files": files})
    return out


GIT_LOG = "sha string, author string, author_email string, timestamp long, message string, parents string, files array<struct<file_path:string,change_type:string,insertions:long,deletions:long>>"


def git_refs(text: str | None) -> list[dict]:
    out = []
    for line in (text or "").splitlines():
        sha, _, name = line.partition(" ")
        if name:
            kind = "branch" if name.startswith("refs/heads/") else "tag" if name.startswith("refs/tags/") else "other"
            out.append({"commit_sha": sha, "ref_name": re.sub(r"^refs/(heads|tags)/", "", name), "ref_type": kind})
    return out


def blame(text: str | None) -> list[dict]:
    """Lines of `git blame --line-porcelain`."""
    out: list[dict] = []
    row: dict = {}
    for line in (text or "").split("\n"):
        if m := re.match(r"([0-9a-f]{40}) \d+ (\d+)", line):
            row = {"sha": m[1], "line": int(m[2])}
        elif line.startswith("\t"):
            out.append(row | {"text": line[1:]})
        else:
            key, _, value = line.partition(" ")
            name = {"author": "author", "author-mail": "author_email", "author-time": "timestamp", "summary": "summary"}.get(key)
            if name:
                row[name] = int(value) if name == "timestamp" else value.strip("<>") if name == "author_email" else value
    return out


def line_history(text: str | None) -> list[dict]:
    """Commits of `git log -L` in the block format, with the patch as text."""
    out = []
    for block in (text or "").split(COMMIT + "\n")[1:]:
        lines = block.split("\n")
        if len(lines) >= 6:
            out.append({"sha": lines[0], "author": lines[1], "author_email": lines[2], "timestamp": int(lines[3]), "message": lines[5], "patch": "\n".join(lines[6:]).strip("\n")})
    return out


def _scalar(value: str) -> str:
    value = value.strip()
    if len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'":
        return value[1:-1]
    return re.sub(r"\s+#.*$", "", value).strip()


def scalar_type(value) -> str:
    if value is None or value == "":
        return "null" if value is None else "string"
    if isinstance(value, bool) or str(value).lower() in ("true", "false"):
        return "boolean"
    return "number" if isinstance(value, int | float) or re.fullmatch(r"-?\d+(\.\d+)?", str(value)) else "string"


def config(path: str | None, text: str | None) -> list[dict]:
    """(key, value, type) of an env, JSON, TOML or YAML file, nested keys joined by dots. Broken files give
    nothing; the YAML subset is maps, lists and scalars."""
    text, name = text or "", (path or "").rsplit("/", 1)[-1]
    if name.startswith(".env") or name.endswith(".env"):
        rows = []
        for line in text.splitlines():
            if m := re.match(r"\s*(?:export\s+)?([A-Za-z_]\w*)\s*=(.*)$", line):
                rows.append((m[1], _scalar(m[2])))
        return [{"key": k, "value": v, "type": scalar_type(v)} for k, v in rows]
    try:
        if name.endswith(".json"):
            data = json.loads(text)
        elif name.endswith(".toml"):
            import tomllib

            data = tomllib.loads(text)
        elif name.endswith((".yml", ".yaml")):
            data = _yaml(text)
        else:
            return []
    except ValueError:
        return []
    return [{"key": k, "value": None if v is None else str(v).lower() if isinstance(v, bool) else str(v), "type": scalar_type(v)} for k, v in _flat(data)]


def _flat(data, prefix: str = ""):
    if isinstance(data, dict):
        for k, v in data.items():
            yield from _flat(v, f"{prefix}.{k}" if prefix else str(k))
    elif isinstance(data, list):
        for i, v in enumerate(data):
            yield from _flat(v, f"{prefix}.{i}" if prefix else str(i))
    else:
        yield prefix, data


def _yaml(text: str) -> dict:
    root: dict = {}
    stack: list[tuple[int, dict]] = [(-1, root)]
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        indent = len(line) - len(line.lstrip())
        while stack[-1][0] >= indent:
            stack.pop()
        body = line.strip()
        if body.startswith("- "):
            own = stack[-1][1]
            own[str(sum(k.isdigit() for k in own))] = _scalar(body[2:])
        elif ":" in body:
            k, _, v = body.partition(":")
            if v.strip():
                stack[-1][1][_scalar(k)] = _scalar(v)
            else:
                child: dict = {}
                stack[-1][1][_scalar(k)] = child
                stack.append((indent, child))
    return root


def masked_c(text: str | None) -> str:
    """C source with line continuations joined and comments blanked; strings and lines keep their places."""
    return without_comments((text or "").replace("\\\r\n", "").replace("\\\n", ""))


def without_comments(text: str) -> str:
    """C source with comments blanked, those over several lines too; all else keeps its place."""
    token = re.compile(r'//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])*\'?', re.S)
    return token.sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0].startswith(("//", "/*")) else m[0], text)


def c_includes(text: str | None) -> list[dict]:
    """Literal includes in order, each once: raw with its quotes or brackets."""
    found = re.findall(r'^[ \t]*#[ \t]*include[ \t]*(<[^>\n]+>|"[^"\n]+")', masked_c(text), re.M)
    return [{"position": i, "raw_import": raw if raw[0] == "<" else raw[1:-1]} for i, raw in enumerate(dict.fromkeys(found))]


def c_macros(text: str | None) -> list[dict]:
    """#define rows: name, parameters, value, line and end_line (zero-based), and the conditions around."""
    lines = without_comments(text or "").split("\n")
    out, conditions, i = [], [], 0
    while i < len(lines):
        first, line = i, lines[i]
        while line.endswith("\\") and i + 1 < len(lines):
            i += 1
            line = line[:-1] + lines[i]
        i += 1
        line = line.rstrip()
        m = re.match(r"\s*#\s*(\w+)\s*(.*)$", line)
        if not m:
            continue
        word, rest = m[1], m[2]
        if word in ("if", "ifdef", "ifndef"):
            conditions.append({"if": rest, "ifdef": f"defined({rest})", "ifndef": f"!defined({rest})"}[word])
        elif word == "elif" and conditions:
            conditions[-1] = f"!({conditions[-1]}) && ({rest})"
        elif word == "else" and conditions:
            conditions[-1] = f"!({conditions[-1]})"
        elif word == "endif" and conditions:
            conditions.pop()
        elif word == "define" and (d := re.match(r"(\w+)(\([^)]*\))?\s*(.*)$", rest)):
            out.append({"name": d[1], "parameters": d[2], "value": d[3], "line": first, "end_line": i - 1, "conditions": list(conditions)})
    return out


def include_paths(arguments: list[str], cwd: str) -> list[str]:
    """Directories of -I, -iquote, -isystem and /I, joined or separate, absolute, each once."""
    out, i = [], 0
    while i < len(arguments):
        a = arguments[i]
        for flag in ("-I", "-iquote", "-isystem", "/I"):
            if a == flag and i + 1 < len(arguments):
                i += 1
                out.append(arguments[i])
                break
            if a.startswith(flag) and len(a) > len(flag):
                out.append(a[len(flag) :].strip())
                break
        i += 1
    return list(dict.fromkeys(absolute(p, cwd) for p in out))


def absolute(path: str, cwd: str) -> str:
    parts: list[str] = []
    for p in (path if path.startswith("/") else f"{cwd}/{path}").split("/"):
        if p == "..":
            parts[-1:] = []
        elif p not in ("", "."):
            parts.append(p)
    return "/" + "/".join(parts)


def unit_language(arguments: list[str], path: str) -> str:
    """c or cpp by -x, -std, the tool and the extension; unknown if none of them tells."""
    for i, a in enumerate(arguments):
        x = arguments[i + 1] if a == "-x" and i + 1 < len(arguments) else a[2:] if a.startswith("-x") and len(a) > 2 else None
        if x:
            return "cpp" if x.startswith("c++") else "c"
        if a.startswith("-std="):
            return "cpp" if "++" in a else "c"
    tool = arguments[0].rsplit("/", 1)[-1] if arguments else ""
    if "++" in tool or re.search(r"\.(cc|cpp|cxx|c\+\+|C|hpp|hh|hxx|h\+\+)$", path):
        return "cpp"
    return "c" if path.endswith((".c", ".h")) else "unknown"


def compile_commands(text: str | None, folder: str | None = None) -> list[dict]:
    """Units of a compilation database: path, language, includes and status (valid or why not). Entries
    without a directory lie in the database's own folder, if that is given."""
    try:
        data = json.loads(text or "")
    except ValueError:
        return []
    out = []
    for e in data if isinstance(data, list) else []:
        own = (e.get("directory") or folder) if isinstance(e, dict) else None
        if not isinstance(own, str) or not isinstance(e.get("file"), str):
            out.append({"path": None, "language": None, "includes": [], "status": "incomplete"})
            continue
        args = e.get("arguments")
        try:
            args = args if isinstance(args, list) else shlex.split(e.get("command") or "")
        except ValueError:
            args = []
        path = absolute(e["file"], own)
        out.append({"path": path, "language": unit_language(args, path), "includes": include_paths(args, own), "status": "valid" if args else "no command"})
    return out


def lsp_symbols(text: str | None) -> list[dict]:
    """Document symbols in JSON, flattened in order, with the chain of parents as kind:name; modules are left
    out but their children are not."""
    out: list[dict] = []

    def walk(nodes, chain, parent):
        for n in nodes or []:
            kind = KINDS.get(n.get("kind"), "variable")
            r, s = n.get("range") or n.get("location", {}).get("range"), n.get("selectionRange")
            mine, below = parent, chain
            if kind != "module":
                out.append({"name": n["name"], "kind": kind, "start_line": r["start"]["line"], "start_character": r["start"]["character"], "end_line": r["end"]["line"], "end_character": r["end"]["character"], "selection_line": s["start"]["line"] if s else None, "selection_character": s["start"]["character"] if s else None, "parents": list(chain), "parent": parent, "position": len(out)})
                mine, below = len(out) - 1, [*chain, f"{kind}:{n['name']}"]
            walk(n.get("children"), below, mine)

    try:
        walk(json.loads(text or "[]"), [], None)
    except ValueError:
        return []
    return out


# fixed values: symbol kinds of the language server protocol
KINDS = {1: "file", 2: "module", 3: "namespace", 4: "package", 5: "class", 6: "method", 7: "property", 8: "field", 9: "constructor", 10: "enum", 11: "interface", 12: "function", 13: "variable", 14: "constant", 15: "string", 16: "number", 17: "boolean", 18: "array", 19: "object", 20: "key", 21: "null", 22: "enum_member", 23: "struct", 24: "event", 25: "operator", 26: "type_parameter"}


def hover_text(value) -> str | None:
    """Text of a hover's contents: string, object or list of them, without code fences."""
    if isinstance(value, list):
        parts = [t for t in map(hover_text, value) if t]
        return "\n".join(parts) or None
    if isinstance(value, dict):
        value = value.get("value")
    if not isinstance(value, str):
        return None
    return "\n".join(x for x in value.split("\n") if not x.startswith("```")).strip() or None


def definition_of(value) -> dict | None:
    """First location of a definition answer; of a link the selection range first."""
    value = value[0] if isinstance(value, list) and value else value
    if not isinstance(value, dict):
        return None
    uri = value.get("targetUri") or value.get("uri")
    r = value.get("targetSelectionRange") or value.get("targetRange") or value.get("range")
    return {"uri": uri, "line": r["start"]["line"], "character": r["start"]["character"]} if uri and r else None
