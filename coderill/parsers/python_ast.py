"""Python: imports, classes, functions, decorators, type hints, variables and calls, by the standard syntax tree."""

from __future__ import annotations

import ast
from collections.abc import Iterator

_BRANCH = (ast.If, ast.While, ast.For, ast.AsyncFor, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.Assert, ast.comprehension, ast.IfExp)


def complexity(node: ast.AST) -> int:
    """1 and one for each branch, and for each operand of ``and``/``or`` beyond the first; inner functions count too."""
    n = 1
    for x in ast.walk(node):
        if isinstance(x, _BRANCH):
            n += 1
        elif isinstance(x, ast.BoolOp):
            n += len(x.values) - 1
    return n


def dotted(node: ast.AST) -> str | None:
    """The name of a plain or dotted reference, that of a call's or subscript's head else."""
    match node:
        case ast.Name(id=name):
            return name
        case ast.Attribute(value=head, attr=name):
            before = dotted(head)
            return f"{before}.{name}" if before else name
        case ast.Call(func=head) | ast.Subscript(value=head):
            return dotted(head)
    return None


def _hint(node: ast.AST, **more) -> tuple[str, dict]:
    text = ast.unparse(node)
    return "type_hint", more | {"type_annotation": text, "is_optional": text.startswith("Optional[") or "None" in text.replace(" ", "").split("|")}


class _Visitor(ast.NodeVisitor):
    def __init__(self):
        self.out: list[tuple[str, dict]] = []
        self.classes: list[str] = []
        self.functions: list[str] = []

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.out.append(("import", {"to_module": a.name, "import_name": a.name, "alias": a.asname, "import_kind": "import", "is_relative": False, "is_wildcard": False, "line": node.lineno}))

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        target = "." * node.level + (node.module or "")
        for a in node.names:
            self.out.append(("import", {"to_module": target, "import_name": a.name, "alias": a.asname, "import_kind": "from", "is_relative": node.level > 0, "is_wildcard": a.name == "*", "line": node.lineno}))

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.out.append(("class", {"name": node.name, "kind": "class", "line_start": node.lineno, "line_end": node.end_lineno, "docstring": ast.get_docstring(node)}))
        for k, base in enumerate(node.bases):
            if name := dotted(base):
                self.out.append(("inheritance", {"class": node.name, "base": name, "relationship_kind": "inherits", "position": k}))
        self._decorators(node, "class")
        for x in node.body:
            targets = [x.target] if isinstance(x, ast.AnnAssign) else x.targets if isinstance(x, ast.Assign) else []
            for t in targets:
                if isinstance(t, ast.Name):
                    self.out.append(("variable", {"class": node.name, "name": t.id, "kind": "class_field", "line": x.lineno}))
                    if isinstance(x, ast.AnnAssign):
                        self.out.append(_hint(x.annotation, owner=f"{node.name}.{t.id}", hint_type="variable", parameter_name=None))
        self.classes.append(node.name)
        outer, self.functions = self.functions, []
        self.generic_visit(node)
        self.functions = outer
        self.classes.pop()

    def _decorators(self, node, kind: str) -> None:
        for d in node.decorator_list:
            given = ", ".join(ast.unparse(a) for a in [*d.args, *d.keywords]) if isinstance(d, ast.Call) else None
            self.out.append(("decorator", {"target_type": kind, "target": node.name, "decorator_name": dotted(d) or ast.unparse(d), "arguments": given, "line": d.lineno}))

    def _function(self, node) -> None:
        owner = self.classes[-1] if self.classes and not self.functions else None
        plain = "constructor" if owner and node.name == "__init__" else "method" if owner else "function"
        is_async = isinstance(node, ast.AsyncFunctionDef)
        self.out.append((
            "function",
            {"name": node.name, "class": owner, "kind": f"async_{plain}" if is_async else plain, "line_start": node.lineno, "line_end": node.end_lineno, "docstring": ast.get_docstring(node), "cyclomatic_complexity": complexity(node), "is_async": is_async},
        ))
        self._decorators(node, "function")
        a = node.args
        for x in [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]:
            if x.annotation is not None:
                self.out.append(_hint(x.annotation, owner=node.name, hint_type="parameter", parameter_name=x.arg))
        if node.returns is not None:
            self.out.append(_hint(node.returns, owner=node.name, hint_type="return", parameter_name=None))
        # decorators belong to what is around
        for d in node.decorator_list:
            self.visit(d)
        self.functions.append(node.name)
        for x in [node.args, *([node.returns] if node.returns else []), *node.body]:
            self.visit(x)
        self.functions.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_Call(self, node: ast.Call) -> None:
        if self.functions and (name := dotted(node.func)):
            self.out.append(("call", {"from": self.functions[-1], "to_name": name, "call_kind": "method" if isinstance(node.func, ast.Attribute) else "function", "line": node.lineno}))
        self.generic_visit(node)


def entities(text: str) -> Iterator[tuple[str, dict]]:
    """Nothing for a text that has a syntax error."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    v = _Visitor()
    v.visit(tree)
    yield from v.out
