"""Symbols, imports, exports and comments of source files.

All files go through one Arrow pass; whole tables of plain text can also be cut up by Spark itself (text_sections, paragraphs).
For languages with a grammar a table of declarations for each language names what starts a symbol, and the end of its block is
found by braces, by indentation or by `end`. A file that cannot be parsed gives an error and no symbols, and stops nothing.
"""

from __future__ import annotations

import ast
import csv
import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.memory import give_back, slices
from ..functions.text import trimmed
from ..shipping import ship

Symbol = dict  # name, type, start, end, parent (start line of the parent or None), meta


def sym(name: str, kind: str, start: int, end: int | None = None, parent: int | None = None, **meta) -> Symbol:
    return {"name": name, "type": kind, "start": start, "end": start if end is None else end, "parent": parent, "meta": {k: str(v) for k, v in meta.items()}}


# Declarations: (pattern whose group 1 is the name, kind). Modifiers before a declaration are allowed for.
_MOD = r"^\s*(?:(?:export|default|public|private|protected|internal|static|final|abstract|async|override|open|sealed|data|partial|virtual|inline|unsafe|extern|const|pub(?:\([^)]*\))?|external|suspend|case|implicit|lazy)\s+)*"
_TYPES = [(_MOD + r"class\s+(\w+)", "class"), (_MOD + r"interface\s+(\w+)", "interface"), (_MOD + r"enum\s+(?:class\s+|struct\s+)?(\w+)", "enum")]
_CALLABLE = r"(?!.*\b(?:if|for|while|switch|return|else|catch|new|throw)\b\s*\()"
_C_LIKE = (r"^(?!\s*(?:return|else|if|for|while|switch|new|throw|typedef|#)\b)\s*[A-Za-z_][\w\s:<>,*&\[\]~]*?[\s*&]([A-Za-z_~]\w*)\s*\([^;]*$", "function")
_JAVA_LIKE = (r"^\s*(?:(?:public|private|protected|internal|static|final|abstract|async|override|virtual|synchronized)\s+)+[\w<>\[\],.? ]+\s+(\w+)\s*\((?:[^;]*$|[^;{]*\)\s*(?:throws\s+[\w,. ]+)?\{.*$)", "method")
#: Java and C#: members of a class without a modifier, whose body or parameters begin on the line.
_BARE_MEMBER = (r"^\s+(?!(?:return|else|new|throw|if|for|while|switch|catch|case|do|try|await|yield|using|lock|assert|goto)\b)(?:<[^>]*>\s*)?[A-Za-z_][\w<>\[\],.?]*(?:\s*<[^>]*>)?(?:\[\])*\s+(\w+)\s*\((?:[^;=]*$|[^;={]*\)\s*(?:throws\s+[\w,. ]+)?\{.*$)", "method")
_JS = [(_MOD + r"function\s*\*?\s*(\w+)", "function"), (_MOD + r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>", "function"), (_MOD + r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?function", "function"), (r"^\s+(?:(?:public|private|protected|static|async|get|set|readonly)\s+)*" + _CALLABLE + r"(?!(?:if|for|while|switch|catch|function|return)\b)(\w+)\s*\([^;]*\)\s*(?::[^{;]+)?\{", "method")]
BRACES: dict[str, list[tuple[str, str]]] = {
    "ts": [*_TYPES, *_JS, (r"^\s*(import\b.*)", "import"), (r"^\s*(export\b.*)", "export")],
    "js": [_TYPES[0], *_JS, (r"^\s*(import\b.*)", "import"), (r"^\s*(export\b.*)", "export")],
    "go": [(r"^func\s+(\w+)", "function"), (r"^func\s*\([^)]*\)\s*(\w+)", "method"), (r"^\s*(import\b.*)", "import")],
    "rs": [(_MOD + r"fn\s+(\w+)", "function"), (_MOD + r"struct\s+(\w+)", "struct"), (_MOD + r"trait\s+(\w+)", "trait"), (r"^\s*impl(?:<[^>]*>)?\s+(?:.*\bfor\s+)?(\w+)", "module"), (_MOD + r"enum\s+(\w+)", "enum"), (_MOD + r"use\s+([\w:{}, *]+)", "import")],
    "java": [*_TYPES, _JAVA_LIKE, _BARE_MEMBER, (r"^\s*import\s+([\w.* ]+);", "import")],
    "csharp": [*_TYPES, (_MOD + r"struct\s+(\w+)", "struct"), _JAVA_LIKE, _BARE_MEMBER, (r"^\s*using\s+([\w.= ]+);", "import")],
    "c": [(r"^\s*(?:typedef\s+)?struct\s+(\w+)\s*\{?\s*$", "struct"), _C_LIKE],
    "cpp": [(r"^\s*(?:template\s*<[^>]*>\s*)?class\s+(\w+)[^;]*$", "class"), (r"^\s*struct\s+(\w+)[^;(]*$", "struct"), (r"^\s*enum\s+(?:class\s+)?(\w+)", "enum"), _C_LIKE],
    "php": [_TYPES[0], _TYPES[1], (r"^function\s+&?(\w+)", "function"), (r"^\s+(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+&?(\w+)", "method")],
    "swift": [_TYPES[0], (_MOD + r"struct\s+(\w+)", "struct"), _TYPES[2], (_MOD + r"protocol\s+(\w+)", "protocol"), (_MOD + r"extension\s+(\w+)", "extension"), (_MOD + r"actor\s+(\w+)", "actor"), (_MOD + r"func\s+(\w+)", "function"), (r"^\s*(init)\s*[(<]", "constructor"), (r"^\s*typealias\s+(\w+)", "type_alias"), (_MOD + r"var\s+(\w+)", "property"), (_MOD + r"let\s+(\w+)", "variable"), (r"^\s*import\s+(\w+)", "import")],
    "kotlin": [*_TYPES, (_MOD + r"object\s+(\w+)", "object"), (_MOD + r"fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)", "function"), (_MOD + r"va[lr]\s+(\w+)", "property"), (r"^\s*import\s+([\w.*]+)", "import"), (r"^\s*package\s+([\w.]+)", "package")],
    "dart": [_TYPES[0], (r"^\s*mixin\s+(\w+)", "extension"), (r"^\s*extension\s+(\w+)", "extension"), _TYPES[2], (r"^\s*typedef\s+(\w+)", "type_alias"), (r"^\s*(?:import|export)\s+'([^']+)'", "import"), _C_LIKE, (r"^\s*(?:final|var|const|late)\s+(?:\w+\s+)?(\w+)\s*=", "variable")],
    "scala": [(_MOD + r"class\s+(\w+)", "class"), (_MOD + r"trait\s+(\w+)", "trait"), (_MOD + r"object\s+(\w+)", "object"), (_TYPES[2][0], "enum"), (_MOD + r"def\s+(\w+)", "function"), (_MOD + r"val\s+(\w+)", "constant"), (_MOD + r"var\s+(\w+)", "variable"), (r"^\s*import\s+([\w.{}, _*=>]+)", "import"), (r"^\s*package\s+([\w.]+)", "package")],
    "solidity": [(r"^\s*(?:abstract\s+)?contract\s+(\w+)", "class"), (r"^\s*interface\s+(\w+)", "interface"), (r"^\s*library\s+(\w+)", "module"), (r"^\s*struct\s+(\w+)", "struct"), (r"^\s*enum\s+(\w+)", "enum"), (r"^\s*event\s+(\w+)", "function"), (r"^\s*modifier\s+(\w+)", "method"), (r"^\s*(constructor)\s*\(", "constructor"), (r"^\s*function\s+(\w+)", "function"), (r"^\s*(?:u?int\d*|address|bool|string|bytes\d*|mapping\s*\(.*\))\s+(?:(?:public|private|internal|constant|immutable)\s+)*(\w+)\s*[=;]", "variable"), (r"^\s*import\s+\"?([^\";]+)", "import")],
    "css": [(r"^\s*([^@{}/][^{};]*?)\s*(?:,[^{}]*)?\{", "module")],
    "terraform": [(r"^\s*(\w+)(?:\s+\"[^\"]*\")*\s*\{", "module"), (r"^\s*(\w+)\s*=", "property")],
}
INDENTED: dict[str, list[tuple[str, str]]] = {
    "rb": [(r"^\s*def\s+(?:self\.)?([\w?!]+)", "method"), (r"^\s*class\s+([\w:]+)", "class"), (r"^\s*module\s+([\w:]+)", "module"), (r"^\s*require(?:_relative)?\s+['\"]([^'\"]+)", "import")],
    "lua": [(r"^\s*(?:local\s+)?function\s+(\w+)\s*\(", "function"), (r"^\s*function\s+[\w]+[.:](\w+)", "method"), (r"^\s*(?:local\s+)?(\w+)\s*=\s*\{", "struct"), (r"^\s*local\s+\w+\s*=\s*require\s*\(?['\"]([^'\"]+)", "import"), (r"^\s*local\s+(\w+)\s*=\s*(?!require|\{)", "variable")],
    "haskell": [(r"^data\s+(\w+)", "struct"), (r"^type\s+(\w+)", "type_alias"), (r"^class\s+(?:.*=>\s*)?(\w+)", "interface"), (r"^instance\s+(?:.*=>\s*)?(\w+)", "object"), (r"^(\w+)\s*::", "function"), (r"^import\s+(?:qualified\s+)?([\w.]+)", "import"), (r"^module\s+([\w.]+)", "module")],
}
#: Lines that are an import or an export as a whole.
IMPORT_LINES = {"ts": r"^\s*import\b", "js": r"^\s*import\b", "py": r"^\s*(?:import|from)\b", "go": r"^\s*import\b", "rs": r"^\s*(?:pub\s+)?use\b", "java": r"^\s*import\b", "rb": r"^\s*require", "c": r"^\s*#include", "cpp": r"^\s*(?:#include|using)\b", "csharp": r"^\s*using\b", "swift": r"^\s*import\b", "kotlin": r"^\s*import\b", "dart": r"^\s*(?:import|export)\b", "scala": r"^\s*import\b", "haskell": r"^import\b", "solidity": r"^\s*import\b", "lua": r"require\s*\(?['\"]", "astro": r"^import\s.+\sfrom\s"}
EXPORT_LINES = {"ts": r"^\s*export\b", "js": r"^\s*export\b"}
_COMMENTS = {"#": "py rb dockerfile yaml toml terraform config csv", "--": "sql lua haskell", "//": "ts js go rs java c cpp csharp php swift kotlin dart scala solidity css salesforce astro", "<!--": "html xml vue svelte markdown svg", ";": "config", "!": "config"}


#: Languages whose imports may go on over lines while a bracket is open, and what begins such a list of exports.
_LISTED_IMPORTS = frozenset("ts js go rs dart scala solidity py".split())
_LISTED_EXPORT = re.compile(r"^\s*export\s*(?:type\s*)?\{")
_QUOTED = re.compile(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|//.*")


def _statement(lines: list[str], i: int) -> int:
    """The line on which the brackets that line i leaves open are closed; i if they never are."""
    depth = 0
    for j in range(i, len(lines)):
        text = _QUOTED.sub("", lines[j])
        depth += sum(map(text.count, "({")) - sum(map(text.count, ")}"))
        if depth <= 0:
            return j
    return i


_TEMPLATES = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)


def _without_templates(text: str) -> str:
    """The text with template literals and block comments blank, their line ends kept: braces in them end no block."""
    return _TEMPLATES.sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0][0] == "`" or m[0].startswith("/*") else m[0], text)


def _brace_end(lines: list[str], i: int) -> int:
    """The line on which the braces that open on or after line i are closed; i if a statement ends first. While brackets of the
    declaration are open, and on the line after, its braces may still come."""
    depth, opened, brackets, closed = 0, False, 0, i
    for j in range(i, len(lines)):
        text = re.sub(r"//.*|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", "", lines[j])
        for c in text:
            if c == "{":
                depth, opened = depth + 1, True
            elif c == "}":
                depth -= 1
                if opened and depth == 0:
                    return j
        brackets += text.count("(") + text.count("[") - text.count(")") - text.count("]")
        if brackets > 0 or not text.strip():
            closed = j + 1
        elif not opened and (";" in text or j > closed):
            return i
    return i if not opened else len(lines) - 1


def _indent_end(lines: list[str], i: int) -> int:
    """The last line before one that is indented no deeper, that line itself if it is `end`."""
    width = len(lines[i]) - len(lines[i].lstrip())
    last = i
    for j in range(i + 1, len(lines)):
        s = lines[j].strip()
        if s and len(lines[j]) - len(lines[j].lstrip()) <= width:
            return j if s.startswith("end") else last
        last = j if s else last
    return last


def declared(rules: list[tuple[str, str]], end: Callable[[list[str], int], int], templates: bool = False) -> Callable[[str], list[Symbol]]:
    compiled = [(re.compile(p), k) for p, k in rules]

    def parse(text: str) -> list[Symbol]:
        lines, out = text.split("\n"), []
        blocks = _without_templates(text).split("\n") if templates else lines
        for i, line in enumerate(lines):
            for pattern, kind in compiled:
                m = pattern.match(line)
                if m:
                    flat = kind in ("import", "export", "package", "property", "variable", "constant", "type_alias")
                    name, last = m[1].strip(), i
                    if kind == "import" or kind == "export" and _LISTED_EXPORT.match(line):
                        last = _statement(blocks, i)
                        name = " ".join([name, *map(str.strip, lines[i + 1 : last + 1])]) if last > i else name
                    out.append(sym(name, kind, i + 1, last + 1 if flat else end(blocks, i) + 1))
                    if kind != "export":
                        break
        return out

    return parse


def python(text: str) -> list[Symbol]:
    out: list[Symbol] = []

    def walk(node: ast.AST) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
                out.append(sym(n.name, "function", n.lineno, n.end_lineno))
            elif isinstance(n, ast.ClassDef):
                out.append(sym(n.name, "class", n.lineno, n.end_lineno))
            elif isinstance(n, ast.Import | ast.ImportFrom):
                name = n.module or "." if isinstance(n, ast.ImportFrom) else n.names[0].name
                out.append(sym(name, "import", n.lineno, n.end_lineno))
            walk(n)

    walk(ast.parse(text))
    return out


#: HTML tags that are symbols.
HTML_TAGS = frozenset("script style template main nav header footer section article form aside dialog details".split())
#: XML elements that are modules.
XML_TAGS = frozenset("configuration settings properties beans component module project".split())


class _Tags(HTMLParser):
    def __init__(self, wanted: Callable[[str], str | None], text: str):
        super().__init__(convert_charrefs=False)
        self.wanted, self.open, self.out = wanted, [], []
        self.feed(text)
        self.close()

    def handle_starttag(self, tag, attrs):
        kind = self.wanted(tag)
        parent = next((s["start"] for s in reversed(self.open) if s), None)
        s = sym(tag, kind, self.getpos()[0], parent=parent, tag=tag) if kind else None
        if s:
            self.out.append(s)
        self.open.append(s)
        self.names = [*getattr(self, "names", []), tag]

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        names = getattr(self, "names", [])
        if tag in names:
            k = len(names) - 1 - names[::-1].index(tag)
            for s in self.open[k:]:
                if s:
                    s["end"] = self.getpos()[0]
            self.open, self.names = self.open[:k], names[:k]


def html(text: str) -> list[Symbol]:
    return _Tags(lambda t: "module" if t in HTML_TAGS or "-" in t else None, text).out


_XML = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<[?!][^>]*>|<(/?)([\w:.-]+)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*?)(/?)>", re.S)


def xml(text: str) -> list[Symbol]:
    """Every element, as it is written, below the one that holds it; comments and CDATA are let pass."""
    out, open_, line, at = [], [], 1, 0
    for m in _XML.finditer(text):
        line, at = line + text.count("\n", at, m.start()), m.start()
        if not m[2]:
            continue
        if m[1]:
            k = next((k for k in range(len(open_) - 1, -1, -1) if open_[k]["name"] == m[2]), None)
            if k is not None:
                open_[k]["end"] = line + m[0].count("\n")
                del open_[k:]
            continue
        s = sym(m[2], "module" if m[2].lower() in XML_TAGS else "property", line, parent=open_[-1]["start"] if open_ else None, tag=m[2])
        out.append(s)
        if not m[4]:
            open_.append(s)
    return out


def component(text: str) -> list[Symbol]:
    """Vue and Svelte: blocks are sections, other components classes, control blocks functions."""
    out = [sym(m[1], "section", i + 1) for i, line in enumerate(text.split("\n")) if (m := re.match(r"\s*<(template|script|style)\b", line))]
    for i, line in enumerate(text.split("\n")):
        out += [sym(m[1], "class", i + 1) for m in re.finditer(r"<([A-Z]\w*|[a-z]\w*-[\w-]+)", line)]
        out += [sym(m[1], "function", i + 1) for m in re.finditer(r"\{#(if|each|await)\b", line)]
    return sorted(out, key=lambda s: s["start"])


def json_keys(text: str) -> list[Symbol]:
    """Every key, below the key that holds it; comments and trailing commas are let pass."""
    out, stack, at, line, key = [], [], 0, 1, None
    for m in re.finditer(r"\n|\"(?:\\.|[^\"\\])*\"(?=(\s*:)?)|//[^\n]*|/\*.*?\*/|[{}\[\]]", text, re.S):
        token = m[0]
        line += text.count("\n", at, m.start())
        at = m.start()
        if token in "{[":
            stack.append(key)
        elif token in "}]":
            key = None
            if stack:
                stack.pop()
        elif token[0] == '"' and m[1] is not None:
            s = sym(json.loads(token), "property", line, parent=next((k for k in reversed(stack) if k), None))
            out.append(s)
            key = line
    return out


def lines_of(rules: list[tuple[str, str, str | None]], flags: int = 0, strip: bool = True, every: bool = False) -> Callable[[str], list[Symbol]]:
    """Symbols of single lines: (pattern, kind, fixed name or None for group 1). every: all matches of a line, else the first at its start."""
    compiled = [(re.compile(p, flags), k, n) for p, k, n in rules]

    def parse(text: str) -> list[Symbol]:
        out = []
        for i, line in enumerate(text.split("\n")):
            line = line.strip() if strip else line
            for p, kind, name in compiled:
                for m in p.finditer(line) if every else filter(None, [p.match(line)]):
                    out.append(sym(name or m[1], kind, i + 1, **({"instruction": m[1].strip()} if name else {})))
        return out

    return parse


#: What CREATE statements make; a plain INDEX counts twice.
SQL_OBJECTS = [
    (r"TABLE(?:\s+IF\s+NOT\s+EXISTS)?", "table"),
    ("VIEW", "table"),
    ("INDEX", "property"),
    (r"(?:UNIQUE\s+)?INDEX", "property"),
    ("TRIGGER", "function"),
    (r"(?:OR\s+REPLACE\s+)?FUNCTION", "function"),
    (r"(?:OR\s+REPLACE\s+)?PROCEDURE", "function"),
    ("SCHEMA", "namespace"),
    ("DATABASE", "module"),
]
_sql = lines_of([(rf"CREATE\s+{what}\s+[`\"']?(\w+)[`\"']?", kind, None) for what, kind in SQL_OBJECTS], re.I, every=True)


def sql(text: str) -> list[Symbol]:
    """What CREATE statements make; comments of either kind do not count, and lines stay as they are."""
    blank = lambda m: m[0] if m[0][0] in "'\"`" else re.sub(r"[^\n]", " ", m[0])
    return _sql(re.sub(r"'(?:''|[^'])*'|--[^\n]*|/\*.*?(?:\*/|\Z)", blank, text, flags=re.S))


#: Instructions, kinds and the part of the argument that is kept.
INSTRUCTIONS = [
    ("FROM", "import", "(.+)"),
    ("RUN", "function", "(.+)"),
    ("CMD", "function", "(.+)"),
    ("ENTRYPOINT", "function", "(.+)"),
    ("COPY", "function", "(.+)"),
    ("ADD", "function", "(.+)"),
    ("ENV", "variable", r"(\w+)"),
    ("EXPOSE", "variable", r"(\d+)"),
    ("VOLUME", "variable", "(.+)"),
    ("WORKDIR", "variable", "(.+)"),
    ("USER", "variable", "(.+)"),
    ("LABEL", "property", r"(\w+)"),
    ("ARG", "variable", r"(\w+)"),
    ("STOPSIGNAL", "variable", "(.+)"),
    ("HEALTHCHECK", "function", "(.+)"),
    ("SHELL", "function", "(.+)"),
]
dockerfile = lines_of([(rf"{name}\s+{rest}", kind, name) for name, kind, rest in INSTRUCTIONS], re.I)
#: Declarations of Apex.
APEX = [
    (r"(?:public|private|global)\s+(?:with\s+sharing\s+|without\s+sharing\s+)?class\s+(\w+)", "class", None),
    (r"public\s+interface\s+(\w+)", "interface", None),
    (r"public\s+enum\s+(\w+)", "enum", None),
    (r"(?:public|private)\s+(?:static\s+)?(?:void|integer|string|boolean|list|map|set)\s+(\w+)\s*\(", "function", None),
    (r"(?:public\s+)?trigger\s+(\w+)\s+on\s+\w+", "function", None),
]
apex = lines_of(APEX, re.I)
visualforce = lines_of([(r".*?<apex:(\w+)", "class", None)], re.I)
aura = lines_of([(r".*?<aura:(\w+)", "class", None), (r".*?<(\w+-\w+)", "class", None)], re.I)


def salesforce_meta(text: str) -> list[Symbol]:
    out = []
    for i, line in enumerate(text.split("\n")):
        if i < 5 and (m := re.search(r"<(\w+)[\s>]", line)):
            out.append(sym(m[1], "module", i + 1))
        if m := re.search(r"<(\w+)>(.+?)</\1>", line):
            out.append(sym(m[1], "property", i + 1, value=m[2]))
    return out


def keyed(text: str, sections: bool) -> list[Symbol]:
    """k = v lines, below their [section]."""
    out, section = [], None
    for i, line in enumerate(map(str.strip, text.split("\n"))):
        if sections and (m := re.fullmatch(r"\[(.+)\]", line)):
            section = i + 1
            out.append(sym(m[1], "section", section))
        elif not line.startswith(("#", "!", ";")) and (m := re.match(r"([^#=]+?)\s*=\s*(.+)$", line)):
            out.append(sym(m[1].strip(), "property", i + 1, parent=section, value=m[2].strip()))
    return out


_TOML_KEY = r"""(?:"(?:\\.|[^"\\])*"|'[^']*'|[\w-]+)(?:\s*\.\s*(?:"(?:\\.|[^"\\])*"|'[^']*'|[\w-]+))*"""
_TOML = re.compile(rf"[ \t]*(?:#[^\n]*|\[\[?[ \t]*({_TOML_KEY})[ \t]*\]\]?[^\n]*|({_TOML_KEY})[ \t]*=[ \t]*)")
_TOML_VALUE = re.compile(r"""\"{3}.*?\"{3}|'{3}.*?'{3}|"(?:\\.|[^"\\\n])*"|'[^'\n]*'|#[^\n]*|[\[\]{}\n]|[^\[\]{}\n"'#]+""", re.S)


def toml(text: str) -> list[Symbol]:
    """Tables and the keys of each, quoted ones too; a value that goes over several lines belongs to its key."""
    out, section, at, line = [], None, 0, 1
    name = lambda k: re.sub(r"^[\"'](.*)[\"']$", r"\1", k.strip())
    while at < len(text):
        m = _TOML.match(text, at)
        end = m.end() if m else at
        if m and m[1]:
            section = line
            out.append(sym(name(m[1]), "section", line))
        elif m and m[2]:
            depth, start = 0, end
            for v in _TOML_VALUE.finditer(text, end):
                if v.start() != end or v[0] == "\n" and not depth:
                    break
                depth += (v[0] in "[{") - (v[0] in "]}")
                end = v.end()
            value = text[start:end].strip()
            out.append(sym(name(m[2]), "property", line, line + text.count("\n", start, end), parent=section, value=value))
        stop = text.find("\n", end)
        stop = len(text) if stop < 0 else stop + 1
        line, at = line + text.count("\n", at, stop), stop
    return out


_YAML = re.compile(r"""(\s*(?:-\s+)*)("(?:\\.|[^"\\])*"|'[^']*'|[\w.\-/ ]+?)\s*:(?:\s|$)""")
_YAML_FLOW = re.compile(r"""[{,]\s*("(?:\\.|[^"\\])*"|'[^']*'|[\w.\-/ ]+?)\s*:(?=[\s"'\[{]|$)""")


def yaml(text: str) -> list[Symbol]:
    """Keys of block and flow mappings, each below the key that holds it; comments and the lines of block scalars are let pass."""
    out, open_, scalar = [], [], None  # open_: (indent, line) of the keys above
    for i, line in enumerate(text.split("\n")):
        width = len(line) - len(line.lstrip())
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if scalar is not None:
            if width > scalar:
                continue
            scalar = None
        rest = line
        if m := _YAML.match(line):
            width = len(m[1])
            while open_ and open_[-1][0] >= width:
                open_.pop()
            out.append(sym(m[2].strip().strip("\"'"), "property", i + 1, parent=open_[-1][1] if open_ else None))
            open_.append((width, i + 1))
            rest = line[m.end() :]
            if re.match(r"[|>][+-]?\d*\s*(?:#.*)?$", rest.strip()):
                scalar = len(line) - len(line.lstrip())
        if rest.strip().startswith(("{", "- {", "[")):
            out += [sym(f[1].strip().strip("\"'"), "property", i + 1, parent=open_[-1][1] if open_ else None) for f in _YAML_FLOW.finditer(rest)]
    return out


def patterns_file(text: str) -> list[Symbol]:
    return [sym(s, "property", i + 1) for i, line in enumerate(text.split("\n")) if (s := line.strip()) and not s.startswith("#")]


def markdown(text: str) -> list[Symbol]:
    lines, out, fence = text.split("\n"), [], None
    for i, line in enumerate(lines):
        if m := re.match(r"\s{0,3}(?:```|~~~)\s*(\w*)", line):
            if fence is None:
                fence = sym(f"code_block_{m[1] or 'unknown'}", "module", i + 1)
                out.append(fence)
            else:
                fence["end"], fence = i + 1, None
        elif fence is None and (m := re.match(r"\s{0,3}(#{1,6})\s+(.+?)\s*#*$", line)):
            out.append(sym(m[2], "section", i + 1, level=len(m[1])))
        elif fence is None and i and lines[i - 1].strip() and (m := re.fullmatch(r"\s{0,3}(=+|-+)\s*", line)) and not lines[i - 1].lstrip().startswith("#"):
            out.append(sym(lines[i - 1].strip(), "section", i, i + 1, level=1 if m[1][0] == "=" else 2))
    return out


#: Underlines of headings, by level.
_UNDER = ["=", "-", "~", "^", '"', "#", "*", "+"]


def rst(text: str) -> list[Symbol]:
    """Headings are underlined by a run of one character: a line of text that begins with such a character underlines nothing."""
    lines, out, section = [x.strip() for x in text.split("\n")], [], None
    for i, line in enumerate(lines):
        if i and line and line[0] in _UNDER and line == line[0] * len(line) and lines[i - 1] and len(line) >= len(lines[i - 1]):
            section = i
            out.append(sym(lines[i - 1], "section", i, i + 1, level=_UNDER.index(line[0])))
        else:
            if m := re.match(r"\.\.\s+(\w+)::", line):
                out.append(sym(m[1], "function", i + 1, parent=section))
            if line.startswith(".. code-block::"):
                out.append(sym("code-block", "module", i + 1, parent=section))
    return out


def adoc(text: str) -> list[Symbol]:
    out, section = [], None
    for i, line in enumerate(map(str.strip, text.split("\n"))):
        if m := re.fullmatch(r"(={1,6})\s+(.+)", line):
            section = i + 1
            out.append(sym(m[2], "section", section, level=len(m[1])))
        elif m := re.fullmatch(r"\[(.+)\]", line):
            out.append(sym(m[1], "property", i + 1, parent=section))
        elif line in ("----", "...."):
            out.append(sym("code-block", "module", i + 1, parent=section))
    return out


def csv_columns(text: str) -> list[Symbol]:
    """The first row that is no # comment names the columns; a quoted name may hold line ends. What follows is the data."""
    lines = text.rstrip("\n").split("\n")
    first = next((i for i, x in enumerate(lines) if x.strip() and not x.startswith("#")), 0)
    reader = csv.reader(x + "\n" for x in lines[first:])
    names = next(reader, [])
    out = [sym("headers", "module", first + 1, first + max(1, reader.line_num))] + [sym(" ".join(n.split()), "property", first + 1) for n in names if n.strip()]
    after = first + max(1, reader.line_num)
    return out + ([sym("data", "table", after + 1, len(lines))] if len(lines) > after else [])


#: SVG elements that are modules, and others that are properties; names are compared without case.
SVG_MODULES = frozenset("svg g defs symbol marker pattern clippath mask filter".split())
SVG_OTHERS = frozenset(
    "use path rect circle ellipse line polyline polygon text tspan textpath image switch foreignobject animate animatetransform animatemotion set "
    "feblend fecolormatrix fecomponenttransfer fecomposite feconvolvematrix fediffuselighting fedisplacementmap feflood "
    "fegaussianblur feimage femerge femergenode femorphology feoffset fespecularlighting fetile feturbulence".split()
)


def svg(text: str) -> list[Symbol]:
    out = []
    for i, line in enumerate(text.split("\n")):
        if (m := re.search(r"<(\w+)(?:\s|>|/)", line)) and (n := m[1].lower()) in SVG_MODULES | SVG_OTHERS:
            out.append(sym(n, "module" if n in SVG_MODULES else "property", i + 1))
        if m := re.search(r"\bid=[\"']([^\"']+)", line):
            out.append(sym(m[1], "property", i + 1))
        if m := re.search(r"\bclass=[\"']([^\"']+)", line):
            out += [sym(c, "property", i + 1) for c in m[1].split()]
    return out


def log_lines(text: str) -> list[Symbol]:
    out = []
    for i, line in enumerate(map(str.strip, text.split("\n"))):
        if re.match(r"\[?\d{4}-\d{2}-\d{2}|ERROR|WARN|INFO|DEBUG|FATAL|Exception", line, re.I) or re.search("Error|Warning", line, re.I):
            out.append(sym(line[:50], "function", i + 1))
        if "at " in line and "(" in line and ")" in line:
            out.append(sym("stackTrace", "function", i + 1))
    return out


def generic(text: str) -> list[Symbol]:
    """The paragraphs of an unknown file, all of them, each where it stands."""
    out, line, at = [], 1, 0
    for m in [*re.finditer(r"\n\s*\n", text), None]:
        p = text[at : m.start() if m else len(text)]
        if p.strip():
            first = p.split("\n", 1)[0].strip()[:80]
            out.append(sym(first or f"paragraph_{len(out)}", "module", line, line + p.count("\n"), size=len(p)))
        if m:
            line, at = line + p.count("\n") + m[0].count("\n"), m.end()
    return out


def plain_text(text: str) -> list[Symbol]:
    """Headed sections (as text_sections), after the paragraphs before the first; without headings paragraphs parted by blank lines."""
    lines = text.split("\n")
    bare = [x.strip() for x in lines]
    heads = [i for i, x in enumerate(bare) if len(x) >= 3 and (x == x.upper() and re.search("[A-Z]", x) or i + 1 < len(bare) and re.fullmatch("[=-]{3,}", bare[i + 1]))]
    out, part = [], []
    for i in range(heads[0] + 1 if heads else len(bare) + 1):
        if i < len(bare) and bare[i] and i not in heads[:1]:
            part.append(bare[i])
        elif part:
            name = " ".join(part)
            out.append(sym(name[:50], "section", i - len(part) + 1, i, size=len(name)))
            part = []
    return out + [sym(bare[i], "section", i + 1, end) for i, end in zip(heads, [*heads[1:], len(lines)], strict=False)]


def astro(text: str) -> list[Symbol]:
    out, head = [], None
    for i, line in enumerate(map(str.strip, text.split("\n"))):
        if line == "---":
            if head is None:
                head = sym("frontmatter", "section", i + 1)
                out.append(head)
            else:
                head["end"], head = i + 1, None
        elif head is not None:
            if m := re.match(r"import\s+(.+?)\s+from\s+['\"](.+?)['\"]", line):
                out.append(sym(m[1], "import", i + 1, parent=head["start"], source=m[2]))
            elif m := re.match(r"(?:const|let|var)\s+(\w+)", line):
                out.append(sym(m[1], "variable", i + 1, parent=head["start"]))
        else:
            if (m := re.search(r"<(\w[-\w]*)", line)) and (m[1][0].isupper() or "-" in m[1]):
                out.append(sym(m[1], "class", i + 1))
            out += [sym(k, "section", i + 1) for k in ("style", "script") if f"<{k}" in line]
    return out


PARSERS: dict[str, Callable[[str], list[Symbol]]] = (
    {k: declared(v, _brace_end, k in ("ts", "js", "go")) for k, v in BRACES.items()}
    | {k: declared(v, _indent_end) for k, v in INDENTED.items()}
    | {"py": python, "html": html, "xml": xml, "vue": component, "svelte": component, "json": json_keys, "json-variants": json_keys, "sql": sql, "dockerfile": dockerfile, "toml": toml, "yaml": yaml, "markdown": markdown, "csv": csv_columns, "svg": svg, "astro": astro, "generic": generic}
)
#: Languages whose parser depends on the file's ending; the first that fits.
BY_ENDING: dict[str, list[tuple[str, Callable[[str], list[Symbol]]]]] = {
    "config": [(".gitignore", patterns_file), (".ini", lambda t: keyed(t, True)), (".cfg", lambda t: keyed(t, True)), (".editorconfig", lambda t: keyed(t, True)), ("", lambda t: keyed(t, False))],
    "documentation": [(".rst", rst), ("", adoc)],
    "salesforce": [(".cls", apex), (".trigger", apex), (".page", visualforce), (".component", visualforce), (".cmp", aura), (".app", aura), (".evt", aura), (".intf", aura), ("", salesforce_meta)],
    "text": [(".log", log_lines), ("", plain_text)],
}


def register(key: str, parser: Callable[[str], list[Symbol]]) -> None:
    """Another language, or another parser for one. Parsers reach the executors with the plan."""
    PARSERS[key] = parser


def parser(language: str, file: str) -> Callable[[str], list[Symbol]] | None:
    return next((p for end, p in BY_ENDING.get(language, []) if file.endswith(end)), PARSERS.get(language))


def parse(language: str, file: str, text: str, lists: bool = True) -> tuple[list[Symbol], list[str], list[str], list[str], str | None]:
    """symbols, imports, exports, comments, error. lists: whether imports, exports and comments are asked for."""
    try:
        p = parser(language, file)
        found = p(text) if p else []
        if not lists:
            return found, [], [], [], None
        lines = text.split("\n")
        over = lambda i, x: language in _LISTED_IMPORTS and (not re.match(r"\s*export\b", x) or _LISTED_EXPORT.match(x))
        whole = lambda i, x: "\n".join(lines[i : _statement(lines, i) + 1]) if over(i, x) else x
        of = lambda table: [whole(i, x).strip() for i, x in enumerate(lines) if language in table and re.search(table[language], x)]
        marks = tuple(m for m, names in _COMMENTS.items() if language in names.split())
        return found, of(IMPORT_LINES), of(EXPORT_LINES), [x.strip() for x in lines if marks and x.strip().startswith(marks)], None
    except Exception as e:  # noqa: BLE001  one file's fault is reported in its row
        return [], [], [], [], f"{type(e).__name__}: {e}"[:500]


_SYMBOL = pa.struct([("name", pa.string()), ("type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("parent", pa.int32()), ("meta", pa.map_(pa.string(), pa.string()))])
_SYMBOLS = "symbols array<struct<name:string,type:string,start:int,end:int,parent:int,meta:map<string,string>>>"


def parse_batches(batches: Iterator[pa.RecordBatch], lists: bool = True) -> Iterator[pa.RecordBatch]:
    """Batches of file, language, text parsed, a part at a time that is bounded by its text: only that much is Python objects."""
    names = ["symbols", *["imports", "exports", "comments"] * lists, "error"]
    for whole in batches:
        for b in slices(whole, "text"):
            done = [parse(k or "generic", n or "", t or "", lists) for n, k, t in zip(*(b.column(c).to_pylist() for c in ("file", "language", "text")), strict=True)]
            syms = pa.array([[s | {"meta": list(s["meta"].items())} for s in d[0]] for d in done], pa.list_(_SYMBOL))
            each = [pa.array([d[i] for d in done], pa.list_(pa.string())) for i in (1, 2, 3)] if lists else []
            errors = pa.array([d[4] for d in done], pa.string())
            del done
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("language"), syms, *each, errors], ["file", "language", *names])
        give_back()


def parsed(files: DataFrame, lists: bool = True) -> DataFrame:
    """file, language, symbols, imports, exports, comments, error: one row for each of files (file, language, text). Without lists:
    without imports, exports and comments, which may be as long as the text."""
    ship(files.sparkSession)
    table = dict(PARSERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        PARSERS.update(table)
        yield from parse_batches(batches, lists)

    more = "imports array<string>, exports array<string>, comments array<string>, " if lists else ""
    return files.select("file", "language", "text").mapInArrow(run, f"file string, language string, {_SYMBOLS}, {more}error string")


def symbols(files: DataFrame) -> DataFrame:
    """file, seq, id, name, type, language, start_line, end_line, parent, metadata of all symbols."""
    s = parsed(files, False).select("file", "language", F.posexplode("symbols").alias("seq", "s"))
    at = lambda c: F.concat("file", F.lit(":"), c)
    return s.select("file", "seq", at(F.col("s.start")).alias("id"), F.col("s.name").alias("name"), F.col("s.type").alias("type"), "language", F.col("s.start").alias("start_line"), F.col("s.end").alias("end_line"), F.when(F.col("s.parent").isNotNull(), at(F.col("s.parent"))).alias("parent"), F.to_json("s.meta").alias("metadata"))


def text_sections(files: DataFrame) -> DataFrame:
    """file, name, start_line, end_line: headed sections of plain text (capitals, or underlined by = or -), each up to the next header."""
    lines = files.select("file", F.split("text", "\n").alias("lines"))
    each = F.transform("lines", lambda x, i: F.struct(trimmed(x).alias("name"), i.alias("i"), trimmed(F.coalesce(F.get("lines", i + 1), F.lit(""))).alias("under")))
    capitals = lambda x: (x == F.upper(x)) & x.rlike("[A-Z]")
    # The headings of a file are picked inside its row, so nothing is shuffled.
    heads = lines.select("file", F.size("lines").alias("n"), F.filter(each, lambda h: (F.length(h["name"]) >= 3) & (capitals(h["name"]) | h["under"].rlike("^[=-]{3,}$"))).alias("heads"))
    return heads.select("file", "n", "heads", F.posexplode("heads").alias("k", "h")).select("file", F.col("h")["name"].alias("name"), (F.col("h")["i"] + 1).alias("start_line"), F.coalesce(F.get("heads", F.col("k") + 1)["i"], F.col("n")).alias("end_line"))


def paragraphs(files: DataFrame) -> DataFrame:
    """file, seq, name, start_line, end_line of all paragraphs (parted by blank lines), each at its own lines: the fallback for unknown files."""
    blank = lambda i: F.get("lines", i).rlike(r"^\s*$")
    lines = files.select("file", F.split("text", "\n").alias("lines")).filter(F.size("lines") > 0)
    at = F.sequence(F.lit(0), F.size("lines") - 1)
    first = F.filter(at, lambda i: ~blank(i) & ((i == 0) | blank(F.greatest(i - 1, F.lit(0)))))
    last = F.filter(at, lambda i: ~blank(i) & ((i == F.size("lines") - 1) | blank(F.least(i + 1, F.size("lines") - 1))))
    p = lines.select("file", "lines", F.posexplode(F.arrays_zip(first.alias("a"), last.alias("b"))).alias("seq", "p"))
    return p.select("file", "seq", F.substring(trimmed(F.get("lines", F.col("p.a"))), 1, 80).alias("name"), (F.col("p.a") + 1).alias("start_line"), (F.col("p.b") + 1).alias("end_line"))
