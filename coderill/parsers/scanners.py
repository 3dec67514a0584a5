"""Seven brace languages by small scanners: comments and strings are blanked, then declarations are found by pattern and
their ends by matching braces.

What is between quotes is needed for imports only; those are read off the text before strings are blanked.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

_KEYWORDS = set("if for while switch catch return new using lock foreach else do try fixed sizeof typeof nameof when throw await function super this".split())
_REMARK = r"//[^\n]*|/\*.*?\*/"
_DOUBLE, _CHAR = r"\"(?:\\.|[^\"\\\n])*\"", r"'(?:\\[^'\n]+|[^'\\\n])'"
#: A pattern between slashes stands where a value may begin.
_PATTERN = r"(?<=[=(,:\[!&|?{};\n])[ \t]*/(?![*/ ])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*"
_SCRIPT = rf"{_DOUBLE}|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`"
#: What may hold anything, by language: strings of all sorts, raw ones first. A quote that closes no character opens none.
_QUOTED = {
    "csharp": rf"\"\"\".*?\"\"\"|[$]?@[$]?\"(?:\"\"|[^\"])*\"|{_DOUBLE}|{_CHAR}",
    "java": rf"\"\"\"(?:\\.|[^\\])*?\"\"\"|{_DOUBLE}|{_CHAR}",
    "rust": rf"\bb?r(?P<hash>#*)\".*?\"(?P=hash)|\"(?:\\.|[^\"\\])*\"|{_CHAR}",
    "cpp": rf"\b(?:u8|[uUL])?R\"(?P<mark>[^()\\\s]{{0,16}})\(.*?\)(?P=mark)\"|{_DOUBLE}|(?<![0-9A-Fa-f]){_CHAR}",
    "go": rf"{_DOUBLE}|{_CHAR}|`[^`]*`",
}
_BLANK = {k: re.compile(rf"{_REMARK}|{v}", re.S) for k, v in _QUOTED.items()} | dict.fromkeys(("typescript", "javascript"), re.compile(rf"{_REMARK}|{_SCRIPT}|{_PATTERN}", re.S))
_COMMENT = {k: re.compile(rf"{_REMARK}|(?P<text>{v})", re.S) for k, v in _QUOTED.items()} | dict.fromkeys(("typescript", "javascript"), re.compile(rf"{_REMARK}|(?P<text>{_SCRIPT}|{_PATTERN})", re.S))


def _keep_lines(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m[0])


def blanked(text: str, language: str = "typescript") -> str:
    """The text with comments and strings as blanks, of the same length."""
    return _BLANK[language].sub(_keep_lines, text)


def uncommented(text: str, language: str = "typescript") -> str:
    return _COMMENT[language].sub(lambda m: m[0] if m["text"] else _keep_lines(m), text)


def closing(text: str, at: int) -> int:
    """The place of the brace that closes the one at ``at``; the end of the text if none does."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.start()
    return len(text)


def line_of(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def branches(body: str, logic: bool) -> int:
    n = 1 + len(re.findall(r"\b(?:if|while|for|foreach|case|catch)\b|\?(?![.?:])", body))
    return n + (len(re.findall(r"&&|\|\|", body)) if logic else 0)


def _import(to: str, name: str, alias: str | None, kind: str, line: int, relative: bool = False) -> tuple[str, dict]:
    return "import", {"to_module": to, "import_name": name, "alias": alias, "import_kind": kind, "is_relative": relative, "is_dynamic": kind == "dynamic", "is_wildcard": name == "*", "line": line}


def _script_imports(text: str) -> Iterator[tuple[str, dict]]:
    for m in re.finditer(r"\bimport\s+(?:type\s+)?(?:([\w$]+)\s*,?\s*)?(?:\{([^}]*)\}|\*\s*as\s+([\w$]+))?\s*(?:from\s*)?[\"'`]([^\"'`]+)[\"'`]", text):
        default, named, space, to = m.groups()
        at, relative = line_of(text, m.start()), to.startswith(("./", "../"))
        if default:
            yield _import(to, "default", default, "es6", at, relative)
        for part in (named or "").split(","):
            words = part.replace("type ", "").split()
            if words:
                yield _import(to, words[0], words[2] if len(words) == 3 and words[1] == "as" else None, "es6", at, relative)
        if space:
            yield _import(to, "*", space, "es6", at, relative)
        if not (default or named or space):
            yield _import(to, to, None, "es6", at, relative)
    for m in re.finditer(r"(?:(?:const|let|var)\s+(?:([\w$]+)|\{([^}]*)\})\s*=\s*)?\brequire\s*\(\s*[\"'`]([^\"'`]+)[\"'`]\s*\)", text):
        names = [m[1]] if m[1] else [x.split(":")[0].strip() for x in (m[2] or "").split(",") if x.strip()]
        for n in names or [m[3]]:
            yield _import(m[3], n, None, "require", line_of(text, m.start()), m[3].startswith(("./", "../")))
    for m in re.finditer(r"\bimport\s*\(\s*[\"'`]([^\"'`]+)[\"'`]\s*\)", text):
        yield _import(m[1], m[1], None, "dynamic", line_of(text, m.start()), m[1].startswith(("./", "../")))


def _imports(language: str, text: str) -> Iterator[tuple[str, dict]]:
    if language in ("typescript", "javascript"):
        yield from _script_imports(text)
    elif language == "csharp":
        for m in re.finditer(r"^\s*(?:global\s+)?using\s+(static\s+)?(?:([\w]+)\s*=\s*)?([\w.]+)\s*;", text, re.M):
            yield _import(m[3], m[3].split(".")[-1], m[2], "using_static" if m[1] else "using", line_of(text, m.start(3)))
    elif language == "java":
        for m in re.finditer(r"^\s*import\s+(static\s+)?([\w.]+?)(\.\*)?\s*;", text, re.M):
            yield _import(m[2], "*" if m[3] else m[2].split(".")[-1], None, "import", line_of(text, m.start(2)))
    elif language == "rust":
        for m in re.finditer(r"^\s*(?:pub\s+)?use\s+([^;]+);", text, re.M):
            target = re.sub(r"\s+", " ", m[1]).strip()
            plain, _, alias = target.partition(" as ")
            yield _import(plain, plain.split("::")[-1], alias or None, "use", line_of(text, m.start(1)))
    elif language == "cpp":
        for m in re.finditer(r"^\s*#\s*include\s*([<\"])([^>\"\n]+)[>\"]", text, re.M):
            yield _import(m[2], m[2].split("/")[-1], None, "include", line_of(text, m.start(2)))
    elif language == "go":
        for m in re.finditer(r"^\s*import\s*(?:\(([^)]*)\)|((?:[\w.]+\s+)?\"[^\"]+\"))", text, re.M):
            for x in re.finditer(r"(?:([\w.]+)\s+)?\"([^\"]+)\"", m[1] if m[1] is not None else m[2]):
                yield _import(x[2], x[2].split("/")[-1], x[1], "import", line_of(text, m.start()))


_CLASSES = {
    "typescript": r"\b(?:export\s+)?(?:default\s+)?(abstract\s+)?(class|interface|enum)\s+([A-Za-z_$][\w$]*)(?:<[^{]*?>)?([^{;]*)\{",
    "csharp": r"\b((?:public|private|protected|internal|static|sealed|abstract|partial)\s+)*(class|interface|struct|enum|record)\s+([A-Za-z_]\w*)(?:<[^{]*?>)?([^{;]*)\{",
    "java": r"\b((?:public|private|protected|static|final|abstract)\s+)*(class|interface|enum|record)\s+([A-Za-z_]\w*)(?:<[^{]*?>)?([^{;]*)\{",
    "rust": r"\b(pub(?:\([^)]*\))?\s+)?(struct|trait|enum)\s+([A-Za-z_]\w*)([^{;(]*)[{;(]",
    "cpp": r"()\b(class|struct)\s+([A-Za-z_]\w*)(?:\s+final)?\s*(:[^{;]*)?\{",
    "go": r"()\btype\s+([A-Za-z_]\w*)\s+(struct|interface|[\w.\[\]*]+)()",
}
_CLASSES["javascript"] = _CLASSES["typescript"]
_FUNCTIONS = {
    "typescript": r"\b(async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)\s*(?:<[^>]*>)?\(|\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)[^=;\n]*=\s*(async\s*)?(?:\([^)]*\)|[\w$]+)\s*(?::[^=]+)?=>|^[ \t]+(?:(?:public|private|protected|static|readonly|override|get|set)\s+)*(async\s+)?([A-Za-z_$][\w$]*)\s*\([^;{}]*\)\s*(?::[^{;]+)?\{",
    "csharp": r"^[ \t]*(?:(?:public|private|protected|internal|static|virtual|override|abstract|sealed|partial|extern|async|new|unsafe)\s+)*(?:([\w<>\[\],.?]+)\s+)?([A-Za-z_]\w*)\s*(?:<[^>(]*>)?\([^;{})]*\)[^;{}]*[{;]",
    "java": r"^[ \t]*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)*(?:<[^>]*>\s*)?(?:([\w<>\[\],.?]+)\s+)?([A-Za-z_]\w*)\s*\([^;{})]*\)[^;{}]*[{;]",
    "rust": r"\b(async\s+)?(?:unsafe\s+)?fn\s+([A-Za-z_]\w*)",
    "cpp": r"^[ \t]*(?:(?:static|virtual|inline|constexpr|explicit|friend)\s+)*([\w:<>,*&~ ]+?[\s*&])([A-Za-z_~][\w:~]*)\s*\([^;{}]*\)[^;{}]*\{",
    "go": r"\bfunc\s+(\([^)]*\)\s*)?([A-Za-z_]\w*)",
}
_FUNCTIONS["javascript"] = _FUNCTIONS["typescript"]


def _bases(language: str, tail: str, kind: str) -> Iterator[tuple[str, str]]:
    """(base, kind of relation) in the text between a class's name and its brace."""
    names = lambda s: [re.sub(r"<.*", "", x).strip() for x in re.sub(r"<[^<>]*>", "", s).split(",") if x.strip()]
    if language in ("typescript", "javascript", "java"):
        for word, what in (("extends", "extends"), ("implements", "implements")):
            if m := re.search(rf"\b{word}\s+(.*?)(?:\bimplements\b|\bextends\b|$)", tail, re.S):
                yield from ((n, what) for n in names(m[1]))
    elif language == "csharp" and ":" in tail:
        first = True
        for n in names(tail.split(":", 1)[1].split(" where ")[0]):
            yield n, "inherits" if first and not re.match(r"I[A-Z]", n) else "implements"
            first = False
    elif language == "cpp" and tail:
        for n in names(tail.lstrip(":")):
            yield re.sub(r"^(?:(?:public|private|protected|virtual)\s+)+", "", n), "inherits"


def entities(language: str, text: str) -> Iterator[tuple[str, dict]]:
    bare = blanked(text, language)
    yield from _imports(language, uncommented(text, language))
    space = ""
    if language in ("csharp", "java") and (m := re.search(r"^\s*(?:namespace|package)\s+([\w.]+)", bare, re.M)):
        space = m[1] + "."
    spans: list[tuple[int, int, str]] = []
    for m in re.finditer(_CLASSES[language], bare, re.M):
        mark, kind, name, tail = m.groups()
        if language == "go":
            kind, name = (m[3] if m[3] in ("struct", "interface") else "type"), m[2]
        if mark and "abstract" in m[0].split(kind)[0]:
            kind = "abstract_class"
        opened = bare.find("{", m.start()) if "{" in m[0] or language == "go" else -1
        end = closing(bare, opened) if opened >= 0 else m.end()
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        yield "class", {"name": space + name, "kind": kind, "line_start": line_of(bare, start), "line_end": line_of(bare, end), "docstring": None}
        spans.append((start, end, name))
        for k, (base, what) in enumerate(_bases(language, tail or "", kind)):
            yield "inheritance", {"class": space + name, "base": base, "relationship_kind": what, "position": k}
    counts = language in ("typescript", "javascript", "csharp")
    for m in re.finditer(_FUNCTIONS[language], bare, re.M):
        if language in ("typescript", "javascript"):
            name, is_async = m[2] or m[3] or m[6], bool(m[1] or m[4] or m[5])
        else:
            name, is_async = m[2], "async " in m[0][: m[0].find(m[2])]
        owner = next((c for s, e, c in reversed(spans) if s < m.start() < e), None)
        if language not in ("rust", "go") and name in _KEYWORDS or (m.re.groups >= 1 and (m[1] or "").strip() in _KEYWORDS) or (language in ("csharp", "java") and (owner is None or (not m[1] and name != owner))):
            continue
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        opened = bare.find("{", m.end() - 1)
        stop = bare.find(";", m.end() - 1)
        has_body = opened >= 0 and not (0 <= stop < opened)
        end = closing(bare, opened) if has_body else m.end()
        body = bare[opened:end] if has_body else ""
        plain = "constructor" if name in ("constructor", owner) else "method" if owner or (language == "go" and m[1]) else "function"
        yield "function", {
            "name": name, "class": owner, "kind": f"async_{plain}" if is_async else plain, "line_start": line_of(bare, start), "line_end": line_of(bare, end), "docstring": None,
            "cyclomatic_complexity": branches(body, language != "csharp") if counts else 1, "is_async": is_async,
        }
        if language in ("typescript", "javascript"):
            for c in re.finditer(r"([A-Za-z_$][\w$.]*)\s*\(", body):
                if c[1] not in _KEYWORDS:
                    yield "call", {"from": name, "to_name": c[1], "call_kind": "method" if "." in c[1] else "function", "line": line_of(bare, opened + c.start())}
            head = bare[m.start() : opened if has_body else m.end()]
            for p in re.finditer(r"([\w$]+)(\?)?\s*:\s*([\w$.<>\[\]| ]+)", head[head.find("(") : head.rfind(")") + 1]):
                yield "type_hint", {"owner": name, "hint_type": "parameter", "parameter_name": p[1], "type_annotation": p[3].strip(), "is_optional": bool(p[2])}
            if r := re.search(r"\)\s*:\s*([\w$.<>\[\]| ]+?)\s*(?:=>)?\s*$", head.rstrip("{ \n")):
                yield "type_hint", {"owner": name, "hint_type": "return", "parameter_name": None, "type_annotation": r[1].strip(), "is_optional": False}
    if language == "csharp":
        for m in re.finditer(r"^[ \t]*(?:(?:public|private|protected|internal|static|virtual|override|readonly|const)\s+)+([\w<>\[\],.?]+)\s+([A-Za-z_]\w*)\s*(\{\s*(?:get|set|init)|=(?!>)|;)", bare, re.M):
            owner = next((c for s, e, c in reversed(spans) if s < m.start() < e), None)
            kind = "property" if m[3].startswith("{") else "const_field" if "const" in m[0] else "readonly_field" if "readonly" in m[0] else "field"
            yield "variable", {"class": owner, "name": m[2], "kind": kind, "line": line_of(bare, m.start(2))}
            yield "type_hint", {"owner": m[2], "hint_type": "variable", "parameter_name": None, "type_annotation": m[1], "is_optional": m[1].endswith("?")}
