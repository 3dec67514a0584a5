"""From source text to (entity, fact) rows, one function for each language."""

from __future__ import annotations

from collections.abc import Iterator

EXTENSIONS: dict[str, tuple[str, ...]] = {
    "python": (".py", ".pyw"),
    "typescript": (".ts", ".tsx"),
    "javascript": (".cjs", ".mjs", ".jsx", ".js"),
    "csharp": (".cs",),
    "java": (".java",),
    "rust": (".rs",),
    "cpp": (".h", ".hpp", ".hxx", ".cc", ".cpp", ".cxx"),
    "go": (".go",),
}
SKIPPED = set(
    "venv vendor target packages out obj node_modules env dist coverage build bin __pycache__ .vs .venv .tox .pytest_cache .mypy_cache .idea .gradle .git".split()
)
#: Names that generated or bundled files end with.
GENERATED = (".d.ts", ".min.js", ".designer.cs", ".bundle.js", ".g.cs", ".generated.cs")


def parse(language: str, path: str, text: str) -> Iterator[tuple[str, dict]]:
    """A module fact and those of all that it holds."""
    from coderill.parsers import python_ast, scanners

    if path.lower().endswith(GENERATED):
        return
    yield "module", {"lines": text.count("\n") + 1}
    if language == "python":
        yield from python_ast.entities(text)
    else:
        yield from scanners.entities(language, text)
