"""Parsers: a source file to entities and raw edges, run on executors in Arrow batches.

Python is parsed by its own grammar, HTML by the standard parser; the other
languages by tables of patterns over text whose comments and strings are blanked,
with blocks found by braces, `end` or indentation. A parser never fails a job: an
error becomes a row of its own.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cut import cut
from ..schemas import PREFIX
from ..ship import ship

ENTITY = "entity_id string, type string, name string, qualified_name string, language string, file string, start_line int, end_line int, start_col int, end_col int, raw_source string, docstring string, signature string, is_exported boolean, is_async boolean, parent_id string, hash string"
EDGE = "src_id string, dst_id string, type string, line int, confidence float, is_dynamic boolean, file string"
RESULT = f"path string, entities array<struct<{ENTITY.replace(' ', ':').replace(',:', ',')}>>, edges array<struct<{EDGE.replace(' ', ':').replace(',:', ',')}>>, errors array<string>"


@dataclass
class Parsed:
    language: str
    path: str
    source: str
    entities: list[dict] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)

    def __post_init__(self):
        self.lines = self.source.split("\n")
        self.prefix = PREFIX[self.language]
        name = re.sub(r"\.[^./]+$", "", self.path).replace("/", ".")
        self.module = self.entity("module", name, name, 1, len(self.lines), source=self.source)

    def entity(self, kind: str, name: str, qname: str, start: int, end: int, **more) -> str:
        text = more.pop("source", None) or "\n".join(self.lines[start - 1 : end])
        key = f"{self.prefix}:{self.path}:{qname}"
        row = {"entity_id": key, "type": kind, "name": name, "qualified_name": qname, "language": self.language, "file": self.path, "start_line": start, "end_line": max(start, end), "start_col": 0, "end_col": 0, "raw_source": text, "docstring": None, "signature": None, "is_exported": not name.startswith("_"), "is_async": False, "parent_id": None, "hash": hashlib.sha256(text.encode()).hexdigest()}
        if all(e["entity_id"] != key for e in self.entities):  # the first of equal names stays
            self.entities.append(row | more)
        return key

    def edge(self, src: str, dst: str, kind: str, line: int, confidence: float = 0.7, dynamic: bool = False) -> None:
        self.edges.append({"src_id": src, "dst_id": dst, "type": kind, "line": line, "confidence": confidence, "is_dynamic": dynamic, "file": self.path})

    def enclosing(self, line: int) -> str:
        """The smallest function or method around a line, else the module."""
        own = [e for e in self.entities if e["type"] in ("function", "method") and e["start_line"] <= line <= e["end_line"]]
        return min(own, key=lambda e: e["end_line"] - e["start_line"])["entity_id"] if own else self.module


VERBS = ("get", "post", "put", "delete", "patch", "head", "options")


def route(path: str) -> str:
    return "/" + "/".join(x for x in path.strip().split("/") if x)


def parse_python(p: Parsed) -> None:
    tree = ast.parse(p.source)
    top = next(e for e in p.entities if e["entity_id"] == p.module)
    top["docstring"] = ast.get_docstring(tree)

    def add(node, kind: str, scope: str, parent: str | None) -> str:
        begin = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        first = node.body[0].lineno
        head = " ".join(x.strip() for x in p.lines[node.lineno - 1 : max(node.lineno, first - 1 if first > node.lineno else first)])
        return p.entity(kind, node.name, f"{scope}{node.name}", begin, node.end_lineno, docstring=ast.get_docstring(node), signature=re.sub(r":\s*$", "", head), is_async=isinstance(node, ast.AsyncFunctionDef), parent_id=parent, start_col=node.col_offset, end_col=node.end_col_offset)

    def named(x) -> str | None:
        if isinstance(x, ast.Constant) and isinstance(x.value, str):
            return x.value if x.value.isidentifier() else None
        return x.id if isinstance(x, ast.Name) else x.attr if isinstance(x, ast.Attribute) else None

    def types_in(fn, cls: ast.ClassDef | None) -> dict[str, str]:
        """Names with a known class: annotated parameters, constructor calls and annotations, self, its attributes."""
        out: dict[str, str] = {}
        scope = [*ast.walk(cls)] if cls else []
        for x in scope:
            if isinstance(x, ast.Assign) and isinstance(x.value, ast.Call) and (n := named(x.value.func)) and n[:1].isupper():
                out |= {f"self.{t.attr}": n for t in x.targets if isinstance(t, ast.Attribute) and named(t.value) == "self"}
        for a in [*fn.args.posonlyargs, *fn.args.args, *fn.args.kwonlyargs]:
            if a.annotation is not None and (n := named(a.annotation)):
                out[a.arg] = n
        for x in ast.walk(fn):
            if isinstance(x, ast.Assign) and isinstance(x.value, ast.Call) and (n := named(x.value.func)) and n[:1].isupper():
                out |= {t.id: n for t in x.targets if isinstance(t, ast.Name)}
            elif isinstance(x, ast.AnnAssign) and isinstance(x.target, ast.Name) and (n := named(x.annotation)):
                out[x.target.id] = n
        if cls:
            out |= {"self": cls.name, "cls": cls.name}
        return out

    def body(fn, key: str, cls: ast.ClassDef | None) -> None:
        types = types_in(fn, cls)
        for d in fn.decorator_list:
            if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.func.attr in (*VERBS, "route", "websocket") and d.args and isinstance(d.args[0], ast.Constant) and isinstance(d.args[0].value, str):
                methods = [d.func.attr.upper()] if d.func.attr in VERBS else [str(m.value).upper() for k in d.keywords if k.arg == "methods" and isinstance(k.value, (ast.List, ast.Tuple)) for m in k.value.elts] or ["GET"]
                for m in methods:
                    p.edge(f"route:{m} {route(d.args[0].value)}", key, "calls", d.lineno, 0.7, True)
        for default in [*fn.args.defaults, *[x for x in fn.args.kw_defaults if x]]:
            if isinstance(default, ast.Call) and named(default.func) == "Depends" and default.args and (n := named(default.args[0])):
                p.edge(key, f"?call:{n}", "calls", default.lineno, 0.7, True)
        for x in ast.walk(fn):
            if isinstance(x, ast.Call):
                f = x.func
                if isinstance(f, ast.Name):
                    p.edge(key, f"?call:{f.id}", "calls", x.lineno)
                elif isinstance(f, ast.Attribute):
                    at = f"self.{f.value.attr}" if isinstance(f.value, ast.Attribute) and named(f.value.value) == "self" else named(f.value)
                    t = types.get(at or "")
                    p.edge(key, f"?methodcall:{t}.{f.attr}" if t else f"?call:{f.attr}", "calls", x.lineno)

    def members(cls: ast.ClassDef, key: str, scope: str) -> None:
        """Bases, methods and inner classes of a class, to any depth."""
        for i, b in enumerate(cls.bases):
            if n := named(b):
                p.edge(key, f"?inherits:{i}:{n}", "inherits", cls.lineno)
        for x in cls.body:
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                body(x, add(x, "method", scope, key), cls)
            elif isinstance(x, ast.ClassDef):
                members(x, add(x, "class", scope, key), f"{scope}{x.name}.")

    for node in tree.body:
        if isinstance(node, ast.Import):
            for a in node.names:
                p.edge(p.module, f"py:?:{a.name}", "imports", node.lineno, 1.0)
        elif isinstance(node, ast.ImportFrom):
            for a in node.names:
                base = f"py:?rel{node.level}:" if node.level else "py:?:"
                p.edge(p.module, base + ".".join(x for x in (node.module, a.name) if x), "imports", node.lineno, 1.0)
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            body(node, add(node, "function", "", None), None)
        elif isinstance(node, ast.ClassDef):
            members(node, add(node, "class", "", None), f"{node.name}.")
        elif isinstance(node, ast.Assign) and any(named(t) == "urlpatterns" for t in node.targets):
            for x in ast.walk(node.value):
                if isinstance(x, ast.Call) and named(x.func) in ("path", "re_path", "url") and len(x.args) > 1 and isinstance(x.args[0], ast.Constant):
                    target = x.args[1].func.value if isinstance(x.args[1], ast.Call) and isinstance(x.args[1].func, ast.Attribute) and x.args[1].func.attr == "as_view" else x.args[1]
                    if n := named(target):
                        p.edge(f"route:ANY {route(str(x.args[0].value))}", f"route:?handler:{n}", "calls", x.lineno, 0.6, True)


class _Html(HTMLParser):
    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self, p: Parsed):
        super().__init__()
        self.p, self.open = p, []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a, line = dict(attrs), self.getpos()[0]
        key = None
        if a.get("id"):
            parent = next((k for _, k, _ in reversed(self.open) if k), None)
            key = self.p.entity("function", a["id"], a["id"], line, line, parent_id=parent, signature=f"<{tag} id=\"{a['id']}\">")
        if tag == "script" and a.get("src"):
            self.p.edge(self.p.module, f"html:?:{a['src']}", "imports", line, 1.0)
        if tag == "link" and "stylesheet" in (a.get("rel") or "") and a.get("href"):
            self.p.edge(self.p.module, f"html:?:{a['href']}", "imports", line, 1.0)
        if tag not in self.VOID:
            self.open.append((tag, key, line))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                for _, key, start in self.open[i:]:
                    for e in self.p.entities:
                        if key and e["entity_id"] == key:
                            e["end_line"] = self.getpos()[0]
                            e["raw_source"] = "\n".join(self.p.lines[start - 1 : e["end_line"]])
                del self.open[i:]
                return


def parse_html(p: Parsed) -> None:
    _Html(p).feed(p.source)


@dataclass(frozen=True)
class Grammar:
    """Patterns of a language. types: (entity type, pattern with a name and maybe bases); functions: a pattern with a name and maybe a receiver."""

    types: tuple[tuple[str, str], ...] = ()
    functions: tuple[str, ...] = ()
    methods: tuple[str, ...] = ()
    imports: tuple[str, ...] = ()
    import_id: str = "{0}"
    block: str = "brace"
    comments: str = r"//[^\n]*|/\*.*?\*/"
    private: str = r"\bprivate\b"
    calls: bool = True
    owners: tuple[str, ...] = ()  # blocks whose functions are methods of the name


_ID = r"[A-Za-z_$][\w$]*"
_JS_FN = (rf"\bfunction\s*\*?\s*(?P<name>{_ID})\s*\(", rf"\b(?:const|let|var)\s+(?P<name>{_ID})\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^()]*\)|{_ID})\s*(?::[^=\n]+)?=>")
_JS = Grammar(
    types=(("class", rf"\bclass\s+(?P<name>{_ID})(?:\s+extends\s+(?P<bases>{_ID}))?"), ("interface", rf"\binterface\s+(?P<name>{_ID})")),
    functions=_JS_FN,
    methods=(rf"^[ \t]+(?:(?:public|private|protected|static|async|get|set|readonly)\s+)*(?P<name>{_ID})\s*\([^;{{}}]*\)\s*(?::[^{{;\n]+)?\{{",),
    imports=(),
)
_C_FN = rf"^(?:[A-Za-z_][\w:<>,*& \t]*[ \t*&])(?P<name>~?{_ID}(?:::~?{_ID})?)\s*\([^;{{}}]*\)\s*(?:const\s*)?(?:noexcept\s*)?(?:override\s*)?\{{"
_JAVA_M = rf"^[ \t]+(?:@\w+[^\n]*\n[ \t]+)*(?:(?:public|private|protected|internal|static|final|abstract|synchronized|override|virtual|async|default|sealed)\s+)*(?:[\w<>\[\],.? ]+\s+)?(?P<name>{_ID})\s*\([^;{{}}]*\)\s*(?:throws [\w., ]+)?\{{"
GRAMMARS = {
    "typescript": _JS,
    "javascript": _JS,
    "go": Grammar(types=(("class", rf"\btype\s+(?P<name>{_ID})\s+struct"), ("interface", rf"\btype\s+(?P<name>{_ID})\s+interface")), functions=(rf"^func\s+(?:\(\s*\w*\s*\*?(?P<owner>{_ID})[^)]*\)\s*)?(?P<name>{_ID})\s*[\[(]",), imports=(r'^\s*(?:import\s+)?(?:[\w.]+\s+)?"(?P<spec>[^"\n]+)"\s*$',), import_id="go:?:{0}"),
    "rust": Grammar(types=(("class", rf"\b(?:struct|enum)\s+(?P<name>{_ID})"), ("interface", rf"\btrait\s+(?P<name>{_ID})")), functions=(rf"\bfn\s+(?P<name>{_ID})",), imports=(r"^\s*(?:pub\s+)?use\s+(?P<spec>[^;]+);",), import_id="rs:?:{0}", owners=(rf"\bimpl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(?P<name>{_ID})",), private=r"^(?!.*\bpub\b)"),
    "java": Grammar(types=(("class", rf"\b(?:class|enum|record)\s+(?P<name>{_ID})(?:<[^>]*>)?(?:\s+extends\s+(?P<bases>{_ID}))?(?:\s+implements\s+(?P<more>[\w, ]+))?"), ("interface", rf"\binterface\s+(?P<name>{_ID})")), methods=(_JAVA_M,), imports=(r"^\s*import\s+(?:static\s+)?(?P<spec>[\w.*]+)\s*;",), import_id="java:?:{0}"),
    "ruby": Grammar(types=(("class", r"^\s*(?:class|module)\s+(?P<name>[A-Z]\w*)(?:\s*<\s*(?P<bases>[A-Z][\w:]*))?"),), functions=(r"^\s*def\s+(?:self\.)?(?P<name>\w+[?!=]?)",), imports=(r"^\s*require(?:_relative)?\s*\(?[\"'](?P<spec>[^\"'\n]+)[\"']",), import_id="rb:?:{0}", block="end", comments=r"#[^\n]*"),
    "php": Grammar(types=(("class", rf"\b(?:class|trait)\s+(?P<name>{_ID})(?:\s+extends\s+(?P<bases>{_ID}))?(?:\s+implements\s+(?P<more>[\w, ]+))?"), ("interface", rf"\binterface\s+(?P<name>{_ID})")), functions=(rf"\bfunction\s+&?(?P<name>{_ID})\s*\(",), imports=(r"^\s*use\s+(?P<spec>[\w\\]+)[^;]*;", r"\b(?:require|include)(?:_once)?\s*\(?\s*[\"'](?P<spec>[^\"'\n]+)[\"']"), import_id="php:?:{0}", comments=r"//[^\n]*|#[^\n]*|/\*.*?\*/"),
    "c": Grammar(types=(("class", rf"\bstruct\s+(?P<name>{_ID})\s*\{{"), ("class", rf"\btypedef\s+struct[^;]*?\}}\s*(?P<name>{_ID})\s*;")), functions=(_C_FN,), imports=(r"^\s*#\s*include\s*[<\"](?P<spec>[^>\"\n]+)[>\"]",), import_id="c:?:{0}", private=r"\bstatic\b"),
    "cpp": Grammar(types=(("class", rf"\b(?:class|struct)\s+(?P<name>{_ID})\s*(?:final\s*)?(?::\s*(?:public|private|protected)?\s*(?P<bases>{_ID}))?\s*\{{"),), functions=(_C_FN,), methods=(rf"^[ \t]+(?:[\w:<>,*& \t]*[ \t*&])?(?P<name>~?{_ID})\s*\([^;{{}}]*\)\s*(?:const\s*)?(?:override\s*)?\{{",), imports=(r"^\s*#\s*include\s*[<\"](?P<spec>[^>\"\n]+)[>\"]",), import_id="cpp:?:{0}", private=r"\bstatic\b"),
    "kotlin": Grammar(types=(("class", rf"\b(?:class|object)\s+(?P<name>{_ID})"), ("interface", rf"\binterface\s+(?P<name>{_ID})")), functions=(rf"\bfun\s+(?:<[^>]*>\s*)?(?:{_ID}\.)?(?P<name>{_ID})\s*\(",), imports=(r"^\s*import\s+(?P<spec>[\w.*]+)",), import_id="kt:?:{0}", calls=False),
    "csharp": Grammar(types=(("class", rf"\b(?:class|struct|record)\s+(?P<name>{_ID})"), ("interface", rf"\binterface\s+(?P<name>{_ID})")), methods=(_JAVA_M,), calls=False),
    "scala": Grammar(types=(("class", rf"\b(?:class|object)\s+(?P<name>{_ID})"), ("interface", rf"\btrait\s+(?P<name>{_ID})")), functions=(rf"\bdef\s+(?P<name>{_ID})",), imports=(r"^\s*import\s+(?P<spec>[\w.{}, ]+)",), import_id="scala:?:{0}", calls=False),
    "bash": Grammar(functions=(r"^\s*(?:function\s+)?(?P<name>[\w-]+)\s*\(\)\s*\{", r"^\s*function\s+(?P<name>[\w-]+)\s*\{"), comments=r"#[^\n]*", calls=False),
    "elixir": Grammar(types=(("module", r"^\s*defmodule\s+(?P<name>[\w.]+)"),), functions=(r"^\s*def(?:p|macro|macrop)?\s+(?P<name>\w+[?!]?)",), block="end", comments=r"#[^\n]*", private=r"\bdefp\b", calls=False),
    "r": Grammar(functions=(r"^\s*(?P<name>[\w.]+)\s*(?:<-|=)\s*function\s*\(",), comments=r"#[^\n]*", calls=False),
    "julia": Grammar(types=(("class", rf"^\s*(?:mutable\s+)?struct\s+(?P<name>{_ID})"), ("interface", rf"^\s*abstract\s+type\s+(?P<name>{_ID})"), ("module", rf"^\s*module\s+(?P<name>{_ID})")), functions=(r"^\s*(?:function|macro)\s+(?P<name>[\w!]+)",), block="end", comments=r"#[^\n]*", calls=False),
    "haskell": Grammar(types=(("class", r"^(?:data|newtype)\s+(?P<name>[A-Z]\w*)"), ("interface", r"^class\s+(?:[^=>\n]*=>\s*)?(?P<name>[A-Z]\w*)")), functions=(r"^(?P<name>[a-z_][\w']*)(?:\s+[^=|:\n]*)?\s*=(?!=)",), block="indent", comments=r"--[^\n]*|\{-.*?-\}", calls=False),
    "ocaml": Grammar(types=(("module", r"^\s*module\s+(?P<name>[A-Z]\w*)"), ("class", r"^\s*class\s+(?:virtual\s+)?(?P<name>\w+)")), functions=(r"^\s*let\s+(?:rec\s+)?(?P<name>[a-z_][\w']*)",), block="indent", comments=r"\(\*.*?\*\)", calls=False),
    "css": Grammar(comments=r"/\*.*?\*/", calls=False),
    "sql": Grammar(types=(("class", r"(?i)\bcreate\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(?:materialized\s+)?(?:table|view)\s+(?:if\s+not\s+exists\s+)?(?P<name>[\w.\"]+)"),), functions=(r"(?i)\bcreate\s+(?:or\s+replace\s+)?function\s+(?P<name>[\w.\"]+)",), block="semicolon", comments=r"--[^\n]*|/\*.*?\*/", calls=False),
}
_NOT_CALLS = {"if", "for", "while", "switch", "catch", "return", "function", "fn", "def", "func", "sizeof", "match", "elsif", "unless", "foreach", "and", "or", "not", "new", "await", "typeof", "super", "constructor", "require", "require_relative", "include"}


def _blanked(p: Parsed, g: Grammar) -> str:
    """The source with comments and strings replaced by spaces of the same length."""
    pattern = re.compile(rf"({g.comments})|(\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)", re.S)
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), p.source)


def _end(p: Parsed, text: str, at: int, g: Grammar) -> int:
    """Place where the block that begins at or after `at` ends."""
    if g.block == "brace":
        depth = 0
        for m in re.compile(r"[{};]").finditer(text, at):
            if m.group() == "{":
                depth += 1
            elif m.group() == "}":
                depth -= 1
                if depth <= 0:
                    return m.end()
            elif depth == 0:
                return m.end()
        return len(text)
    if g.block == "semicolon":
        i = text.find(";", at)
        return len(text) if i < 0 else i + 1
    line = text.rfind("\n", 0, at) + 1
    indent = len(re.match(r"[ \t]*", text[line:]).group())
    last = at
    for m in re.compile(r"^([ \t]*)(\S[^\n]*)$", re.M).finditer(text, text.find("\n", at) + 1 or len(text)):
        if len(m.group(1)) <= indent:
            return m.end() if g.block == "end" and m.group(2).startswith("end") else last
        last = m.end()
    return last


_ON = rf"(?<![\w.>:$@])(?P<on>[@$]*{_ID}(?:(?:\.|->){_ID})?)"
_CALL = rf"(?:{_ON}(?:\.|->|::))?(?P<name>{_ID})\s*\("
_CALL_RUBY = rf"(?:{_ON}(?:\.|::))?(?P<name>{_ID}[?!]?)(?(on)|\s*\()"
_CLASS = r"(?P<type>[A-Z]\w*)"
#: A name that is given an object made on the spot: new T, T(, T{, T::new, T.new.
_MADE = rf"(?P<name>[@$]*{_ID}(?:(?:\.|->){_ID})?)\s*(?::=|=)\s*&?(?:new\s+)?{_CLASS}(?:\(|::new\b|\.new\b|\{{)"
#: Declarations of a name with a class, without type arguments.
_AFTER = rf"(?P<name>{_ID})\s*\??:\s*&?\s*(?:mut\s+)?{_CLASS}(?![\w<\[.:])"
_BEFORE = rf"\b(?<!new )(?<!return ){_CLASS}(?:\s*[*&]+\s*|\s+)(?P<name>{_ID})\s*(?=[=;,){{])"
_BESIDE = rf"(?P<name>\b[a-z_]\w*)\s+\*?{_CLASS}\s*(?=[,)\n}}]|$)"
_DECLARED = {"typescript": _AFTER, "rust": _AFTER, "java": _BEFORE, "php": _BEFORE, "cpp": _BEFORE, "c": _BEFORE, "go": _BESIDE}
_OWN = ("this", "self")


def _receivers(p: Parsed, text: str, owners: list[tuple[int, int, str, str]]) -> Callable[[str, str], str | None]:
    """known(src, on): the class of what a call in src is made on: this or self, a Go receiver, a local, a parameter or a field."""
    starts = [0, *(m.end() for m in re.finditer("\n", text)), len(text) + 1]
    functions = {e["entity_id"]: e for e in p.entities if e["type"] in ("function", "method")}
    spans = {k: (starts[e["start_line"] - 1], starts[min(e["end_line"], len(starts) - 1)]) for k, e in functions.items()}
    patterns = [re.compile(x, re.M) for x in (_DECLARED.get(p.language), _MADE) if x]
    fields: dict[str, dict[str, str]] = {}
    local: dict[str, dict[str, str]] = {}

    def declared(begin: int, end: int) -> Iterator[tuple[int, str, str]]:
        for pattern in patterns:
            for m in pattern.finditer(text, begin, min(end, len(text))):
                if m["type"] not in _NOT_CALLS:
                    yield m.start(), re.sub("->", ".", m["name"].replace("$", "")), m["type"]

    def fields_of(cls: str) -> dict[str, str]:
        """Fields declared outside of functions, and those that a function of the class gives an object made there."""
        if cls not in fields:
            out = fields[cls] = {}
            for begin, end, name, _ in owners:
                if name != cls:
                    continue
                for at, key, t in declared(begin, end):
                    own = re.match(r"(?:(?:this|self)\.|@+)(\w+)$", key)
                    if own:
                        out.setdefault(own[1], t)
                    elif "." not in key and not any(x <= at < y and x > begin for x, y in spans.values()):
                        out.setdefault(key, t)
        return fields[cls]

    def known(src: str, on: str) -> str | None:
        if not on:
            return None
        e = functions.get(src)
        if src not in local:
            begin, end = spans.get(src, (0, len(text)))
            local[src] = {key: t for _, key, t in declared(begin, end) if "." not in key}
            if e and p.language == "go" and (m := re.match(rf"func\s*\(\s*(\w+)\s+\*?{_CLASS}", text[begin:end])):
                local[src][m[1]] = m["type"]
        cls = e["qualified_name"].rpartition(".")[0] if e and e["type"] == "method" else ""
        first, _, field = on.partition(".")
        if first.startswith("@"):
            return fields_of(cls).get(first.lstrip("@")) if cls and not field else None
        owner = cls if first in _OWN else local[src].get(first)
        if not field or not owner:
            return owner or (None if field or not cls else fields_of(cls).get(first) if p.language in ("java", "cpp") else None)
        return fields_of(owner).get(field)

    return known


def parse_by_grammar(p: Parsed) -> None:
    g = GRAMMARS[p.language]
    text = _blanked(p, g)
    line = lambda i: text.count("\n", 0, i) + 1
    owners: list[tuple[int, int, str, str]] = []  # (start, end, name, id)
    for kind, pattern in g.types:
        for m in re.compile(pattern, re.M).finditer(text):
            name, start = m["name"].strip('"'), m.start("name")
            end = m.end() if m.group().rstrip().endswith(";") else _end(p, text, m.start() + len(m.group().rstrip("{ \t\n")), g)
            head = text[text.rfind("\n", 0, start) + 1 : start]
            key = p.entity(kind, name, name, line(start), line(end - 1), signature=p.lines[line(start) - 1].strip().rstrip("{ "), is_exported=_exported(p.language, name, head, g))
            owners.append((m.start(), end, name, key))
            bases = [m.groupdict().get("bases") or "", *(m.groupdict().get("more") or "").split(",")]
            for i, b in enumerate(x.strip() for x in bases if x and x.strip()):
                p.edge(key, f"?inherits:{i}:{b}", "inherits", line(start))
    for pattern in g.owners:
        for m in re.compile(pattern, re.M).finditer(text):
            owners.append((m.start(), _end(p, text, m.end(), g), m["name"], f"{p.prefix}:{p.path}:{m['name']}"))
    taken: set[int] = set()
    for inside, patterns in ((False, g.functions), (True, g.methods)):
        for pattern in patterns:
            for m in re.compile(pattern, re.M).finditer(text):
                name, start = m["name"], m.start("name")
                own = max((o for o in owners if o[0] < start < o[1]), key=lambda o: o[0], default=None)
                if start in taken or name in _NOT_CALLS - {"constructor"} or inside and own is None:
                    continue
                taken.add(start)
                owner = m.groupdict().get("owner") or (own[2] if own else None)
                if "::" in name:
                    owner, name = name.split("::", 1)
                stop = _end(p, text, start, g)
                head = text[text.rfind("\n", 0, start) + 1 : start]
                p.entity("method" if owner else "function", name, f"{owner}.{name}" if owner else name, line(start), line(stop - 1), signature=p.lines[line(start) - 1].strip().rstrip("{ "), parent_id=f"{p.prefix}:{p.path}:{owner}" if owner else None, is_exported=_exported(p.language, name, head, g), is_async="async" in head)
    for pattern in g.imports:
        for m in re.compile(pattern, re.M).finditer(p.source):
            for spec in _specs(m["spec"].strip(), p.language):
                p.edge(p.module, g.import_id.format(spec), "imports", p.source.count("\n", 0, m.start()) + 1, 1.0)
    if p.language in ("typescript", "javascript"):
        _script(p, text)
    if p.language == "css":
        for m in re.compile(r"(?:^|[{};])\s*([^{};@]+|@keyframes\s+[\w-]+)\s*\{", re.M).finditer(text):
            name = " ".join(m[1].split())[:80]
            p.entity("function", name, name, line(m.start(1)), line(_end(p, text, m.start(1), Grammar()) - 1))
    if g.calls:
        spots = {e["start_line"] for e in p.entities if e["type"] in ("function", "method")}
        known = _receivers(p, text, owners)
        for m in re.compile(_CALL_RUBY if p.language == "ruby" else _CALL, re.M).finditer(text):
            n = line(m.start())
            if m["name"] in _NOT_CALLS or n in spots and re.search(rf"\b(?:function|fn|def|func|void|int)\b.*{re.escape(m['name'])}", p.lines[n - 1]) or m.start("name") in taken:
                continue
            src = p.enclosing(n)
            t = known(src, re.sub(r"->|::", ".", (m["on"] or "").replace("$", "")))
            p.edge(src, f"?methodcall:{t}.{m['name']}" if t else f"?call:{m['name']}", "calls", n)
    _routes(p)


def _exported(language: str, name: str, head: str, g: Grammar) -> bool:
    if language in ("typescript", "javascript"):
        return "export" in head or head.startswith((" ", "\t"))
    if language == "go":
        return name[:1].isupper()
    return not name.startswith("_") and not re.search(g.private, head)


def _specs(spec: str, language: str) -> list[str]:
    """Import paths; groups in braces are taken apart."""
    if language in ("rust", "scala") and (m := re.match(r"(.*?)\{(.*)\}$", spec, re.S)):
        return [m[1].strip() + x.strip() for x in m[2].split(",") if x.strip()]
    return [spec]


def _script(p: Parsed, text: str) -> None:
    for m in re.compile(r"^\s*(?:import|export)\s+(.*?)\s*from\s*[\"']([^\"'\n]+)[\"']", re.M | re.S).finditer(p.source):
        n, what = p.source.count("\n", 0, m.start()) + 1, m[1]
        names = [x.split(" as ")[0].strip().removeprefix("type ") for x in re.sub(r"^[^{]*\{|\}.*$", "", what, flags=re.S).split(",")] if "{" in what else []
        names += ["*"] if what.startswith("*") else []
        head = what.split("{")[0].strip().rstrip(",")
        names += ["default"] if head and not head.startswith(("*", "type")) else []
        for name in filter(None, names):
            p.edge(p.module, f"ts:?:{m[2]}::{name}", "imports", n, 1.0)
    for m in re.compile(r"<([A-Z]\w*)[\s/>]").finditer(text):
        p.edge(p.enclosing(text.count("\n", 0, m.start()) + 1), f"?call:{m[1]}", "calls", text.count("\n", 0, m.start()) + 1)


def _routes(p: Parsed) -> None:
    """Express, Spring and Rails routes, and fetch or axios calls."""
    at = lambda m: p.source.count("\n", 0, m.start()) + 1
    verbs = "|".join(VERBS)
    if p.language in ("typescript", "javascript"):
        for m in re.finditer(rf"\b(?:app|router|\w*[rR]outer)\.({verbs}|all)\(\s*[\"'`]([^\"'`]+)[\"'`]\s*,[^)]*?({_ID})\s*\)", p.source):
            p.edge(f"route:{'ANY' if m[1] == 'all' else m[1].upper()} {route(m[2])}", f"route:?handler:{m[3]}", "calls", at(m), 0.6, True)
        for m in re.finditer(rf"\bfetch\(\s*[\"'`](/[^\"'`$]*)[\"'`](?:\s*,\s*\{{[^}}]*method:\s*[\"'](\w+)[\"'])?|\baxios\.({verbs})\(\s*[\"'`](/[^\"'`$]*)[\"'`]", p.source):
            method, path = ((m[2] or "GET").upper(), m[1]) if m[1] else (m[3].upper(), m[4])
            p.edge(p.enclosing(at(m)), f"route:?http:{method}:{route(path)}", "calls", at(m), 0.5, True)
    if p.language == "java":
        base = re.search(r"@RequestMapping\(\s*(?:value\s*=\s*|path\s*=\s*)?\"([^\"]*)\"[^)]*\)\s*(?:@\w+[^\n]*\s*)*(?:public\s+)?class", p.source)
        for m in re.finditer(rf"@(Get|Post|Put|Delete|Patch|Request)Mapping(?:\(\s*(?:value\s*=\s*|path\s*=\s*)?\"([^\"]*)\"[^)]*\)|\(\))?\s*(?:@\w+[^\n]*\s*)*(?:public|private|protected)?\s*[\w<>\[\], ]+\s+({_ID})\s*\(", p.source):
            method = "ANY" if m[1] == "Request" else m[1].upper()
            p.edge(f"route:{method} {route((base[1] if base else '') + '/' + (m[2] or ''))}", f"route:?handler:{m[3]}", "calls", at(m), 0.7, True)
    if p.language == "ruby":
        for m in re.finditer(rf"^\s*({verbs})\s+[\"']([^\"']+)[\"']\s*,\s*to:\s*[\"'][\w/]+#(\w+)[\"']", p.source, re.M):
            p.edge(f"route:{m[1].upper()} {route(m[2])}", f"route:?handler:{m[3]}", "calls", at(m), 0.6, True)


PARSERS: dict[str, Callable[[Parsed], None]] = {k: parse_by_grammar for k in GRAMMARS} | {"python": parse_python, "html": parse_html}


def parse(path: str, source: str, language: str) -> Parsed:
    """Entities, edges and errors of one file; never raises."""
    p = Parsed(language, path, source)
    try:
        PARSERS[language](p)
    except Exception as e:  # noqa: BLE001  one bad file must not end the job
        p.errors.append(f"{type(e).__name__}: {e}")
    return p


def parsed(files: DataFrame) -> DataFrame:
    """(path, entities, edges, errors) of files (path, source, language)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in parts:
            done = [parse(*r) for r in d[["path", "source", "language"]].itertuples(index=False)]
            yield pd.DataFrame({"path": d["path"], "entities": [x.entities for x in done], "edges": [x.edges for x in done], "errors": [x.errors for x in done]})

    ship(files.sparkSession)
    return files.select("path", "source", "language").mapInPandas(run, RESULT)


def entities_and_edges(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The parsed files' entities and raw edges as tables; edges keep the file they come from."""
    rows = cut(parsed(files))  # each file is parsed once, however often its rows are read
    e = rows.select(F.explode("entities").alias("e")).select("e.*")
    return e, rows.select(F.explode("edges").alias("r")).select("r.*")
