"""Parsers, manifests and interface texts."""

import textwrap

from coderill.parsers import parse
from coderill.parsers.scanners import entities
from coderill.sources import api_text
from coderill.sources.manifests import dependencies


def python(text):
    out = {}
    for kind, fact in parse("python", "x.py", textwrap.dedent(text)):
        out.setdefault(kind, []).append(fact)
    return out


def scan(language, text):
    out = {}
    for kind, fact in entities(language, textwrap.dedent(text)):
        out.setdefault(kind, []).append(fact)
    return out


def test_python_imports():
    got = python("import os, sys\nimport numpy as np\nfrom . import sibling\nfrom ..parent import x as y\nfrom os.path import *\n")["import"]
    assert [(i["to_module"], i["import_name"], i["alias"], i["is_relative"], i["is_wildcard"]) for i in got] == [
        ("os", "os", None, False, False), ("sys", "sys", None, False, False), ("numpy", "numpy", "np", False, False), (".", "sibling", None, True, False), ("..parent", "x", "y", True, False), ("os.path", "*", None, False, True)
    ]


def test_python_structure():
    got = python('''
        class Bird(Animal, base.Flyable):
            """Doc."""
            DEBUG = True
            name: str = "x"
            def __init__(self, n: int, m: "Optional[str]" = None) -> None:
                helper(n)
            @staticmethod
            def s(): pass
        @cache(maxsize=3)
        async def go(x):
            if x and y or z:
                return 1
            elif q:
                return [i for i in x if i]
            print(x.y.z())
        ''')
    assert [(c["name"], c["line_start"], c["docstring"]) for c in got["class"]] == [("Bird", 2, "Doc.")]
    assert [(i["base"], i["position"]) for i in got["inheritance"]] == [("Animal", 0), ("base.Flyable", 1)]
    assert [(f["name"], f["kind"], f["cyclomatic_complexity"], f["is_async"]) for f in got["function"]] == [("__init__", "constructor", 1, False), ("s", "method", 1, False), ("go", "async_function", 6, True)]
    assert [d["decorator_name"] for d in got["decorator"]] == ["staticmethod", "cache"] and got["decorator"][1]["arguments"] == "maxsize=3"
    assert {v["name"] for v in got["variable"]} == {"DEBUG", "name"}
    assert [(h["hint_type"], h["parameter_name"]) for h in got["type_hint"]] == [("variable", None), ("parameter", "n"), ("parameter", "m"), ("return", None)]
    assert {(c["from"], c["to_name"]) for c in got["call"]} == {("__init__", "helper"), ("go", "print"), ("go", "x.y.z")}


def test_python_error_and_generated():
    assert list(parse("python", "x.py", "def (")) == [("module", {"lines": 1})]
    assert list(parse("csharp", "A.Designer.cs", "class A {}")) == []


def test_typescript():
    got = scan("typescript", '''
        import React, { useState as state } from 'react';
        import * as fs from "./fs";
        const x = require('../y');
        // class Ghost {}
        export abstract class Dog extends Animal implements Pet, Named {
          async bark(times: number): Promise<void> {
            if (times > 0 && ok) { log("}"); }
          }
        }
        interface Pet extends Thing {}
        export const go = async (a: string) => { for (;;) { a ? b() : c(); } }
        function plain() {}
        ''')
    assert [(i["to_module"], i["import_name"], i["alias"], i["is_relative"]) for i in got["import"]] == [
        ("react", "default", "React", False), ("react", "useState", "state", False), ("./fs", "*", "fs", True), ("../y", "x", None, True)
    ]
    assert [(c["name"], c["kind"]) for c in got["class"]] == [("Dog", "abstract_class"), ("Pet", "interface")]
    assert [(i["base"], i["relationship_kind"]) for i in got["inheritance"]] == [("Animal", "extends"), ("Pet", "implements"), ("Named", "implements"), ("Thing", "extends")]
    assert {f["name"]: (f["kind"], f["cyclomatic_complexity"]) for f in got["function"]} == {"bark": ("async_method", 3), "go": ("async_function", 3), "plain": ("function", 1)}


def test_csharp_and_java():
    got = scan("csharp", '''
        using System; using static System.Math; using Io = System.IO;
        namespace My.App {
          public sealed class Store : Base, IThing {
            private readonly int count;
            public string Name { get; set; }
            public Store(int n) { }
            public async Task<int> Get(int a) { if (a > 0) { return 1; } return 2; }
          }
        }
        ''')
    assert [c["name"] for c in got["class"]] == ["My.App.Store"]
    assert [(i["base"], i["relationship_kind"]) for i in got["inheritance"]] == [("Base", "inherits"), ("IThing", "implements")]
    assert {f["name"]: (f["kind"], f["cyclomatic_complexity"]) for f in got["function"]} == {"Store": ("constructor", 1), "Get": ("async_method", 2)}
    assert {(v["name"], v["kind"]) for v in got["variable"]} == {("count", "readonly_field"), ("Name", "property")}
    got = scan("java", "package a.b;\nimport java.util.*;\nimport x.Y;\npublic class C extends D implements E, F {\n  void m(int a) { }\n}\n")
    assert [(i["to_module"], i["import_name"]) for i in got["import"]] == [("java.util", "*"), ("x.Y", "Y")]
    assert got["class"][0]["name"] == "a.b.C" and [(i["base"], i["relationship_kind"]) for i in got["inheritance"]] == [("D", "extends"), ("E", "implements"), ("F", "implements")]
    assert [f["name"] for f in got["function"]] == ["m"]


def test_rust_cpp_go():
    got = scan("rust", "use std::io::Read;\npub struct P { x: i32 }\ntrait T {}\nimpl P { pub fn new() -> P { P{x:1} } }\n")
    assert got["import"][0]["import_name"] == "Read" and [(c["name"], c["kind"]) for c in got["class"]] == [("P", "struct"), ("T", "trait")] and got["function"][0]["name"] == "new"
    got = scan("cpp", '#include <vector>\n#include "a/b.h"\nclass Q : public R {\n};\nint main(int c) {\n return 0;\n}\n')
    assert [i["import_name"] for i in got["import"]] == ["vector", "b.h"] and got["inheritance"][0]["base"] == "R" and got["function"][0]["name"] == "main"
    got = scan("go", 'package x\nimport (\n "fmt"\n j "encoding/json"\n)\ntype S struct {\n}\nfunc (s *S) M() {}\nfunc f() {}\n')
    assert [(i["to_module"], i["alias"]) for i in got["import"]] == [("fmt", None), ("encoding/json", "j")]
    assert got["class"][0]["kind"] == "struct" and [(f["name"], f["kind"]) for f in got["function"]] == [("M", "method"), ("f", "function")]


def test_manifests():
    assert list(dependencies("requirements.txt", "flask==2.3.0\n# no\npytest>=7.0.0  # dev dependency\n-r other.txt\nplain\nx~=1.4\n")) == [
        ("pip", "flask", "==2.3.0", False), ("pip", "pytest", ">=7.0.0  # dev dependency", False), ("pip", "plain", "", False), ("pip", "x", "~=1.4", False)
    ]
    assert list(dependencies("a/pyproject.toml", '[tool.poetry.dependencies]\npython = "^3.8"\n[tool.poetry.dev-dependencies]\nblack = "^23"\n[other]\nz = "1"\n')) == [("poetry", "python", "^3.8", False), ("poetry", "black", "^23", True)]
    assert list(dependencies("Cargo.toml", '[dependencies]\nserde = "1.0"\ntokio = { features = ["rt"], version = "1.28" }\n[dev-dependencies]\ncriterion = "0.5"\n')) == [
        ("cargo", "serde", "1.0", False), ("cargo", "tokio", "1.28", False), ("cargo", "criterion", "0.5", True)
    ]
    assert list(dependencies("package.json", '{"dependencies": {"react": "^18"}, "devDependencies": {"jest": "29"}}')) == [("npm", "react", "^18", False), ("npm", "jest", "29", True)]
    assert list(dependencies("package.json", "{")) == []
    pom = '<project xmlns="urn:pom"><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>1</version><scope>test</scope></dependency></dependencies></project>'
    assert list(dependencies("pom.xml", pom)) == [("maven", "g:a", "1", True)]
    assert list(dependencies("go.mod", "module m\nrequire one v1.0\nrequire (\n two v2.1 // indirect\n)\nreplace x v1\n")) == [("go", "one", "v1.0", False), ("go", "two", "v2.1", False)]
    assert list(dependencies("Pipfile", '[packages]\nrequests = "*"\n[dev-packages]\npytest = "*"\n')) == [("pipenv", "requests", "*", False), ("pipenv", "pytest", "*", True)]


def test_interfaces(spark):
    files = spark.createDataFrame([
        ("a.py", "x\n@app.route('/api/users')\ndef u(): pass\n@bp.route(\"/p/<int:id>\", methods=['GET', 'post'])\n@app.get('/f')\n"),
        ("b.ts", "fetch('/api/users');\nfetch(\"/api/x\", { method: 'post' });\naxios.get(`/t/${x}`);\n axios.put('/y', z)\n"),
    ], "path string, text string")
    assert {(r.endpoint_type, r.method, r.path, r.line_number) for r in api_text.endpoints(files).collect()} == {("flask", "GET", "/api/users", 2), ("flask", "GET", "/p/<int:id>", 4), ("flask", "POST", "/p/<int:id>", 4), ("fastapi", "GET", "/f", 5)}
    assert {(r.call_type, r.method, r.url_pattern, r.line_number) for r in api_text.calls(files).collect()} == {("fetch", "GET", "/api/users", 1), ("fetch", "POST", "/api/x", 2), ("axios", "PUT", "/y", 4)}
    types = spark.createDataFrame([
        ("u.proto", "message User { message In { } string n = 1; }\nmessage UserList { }"), ("s.graphql", "type User { id: ID }\ntype Query { u: User }"),
        ("openapi.json", '{"components": {"schemas": {"Pet": {"type": "object"}}}}'), ("bad.json", "{"),
    ], "path string, text string")
    assert {(r.type_system, r.name) for r in api_text.shared_types(types).collect()} >= {("protobuf", "User"), ("protobuf", "UserList"), ("graphql", "User"), ("graphql", "Query"), ("openapi", "Pet")}


def test_what_is_quoted_hides_nothing_and_shows_nothing():
    """Lifetimes, characters, raw strings, text blocks and patterns in which braces and keywords stand."""
    rust = scan("rust", "pub fn longest<'a>(x: &'a str) -> &'a str { x }\nfn q() -> char { '\"' }\nfn r() { let s = r#\"fn no() { \"# ; }\nstruct S<'b> { y: &'b str }\n")
    assert [f["name"] for f in rust["function"]] == ["longest", "q", "r"] and [c["name"] for c in rust["class"]] == ["S"]
    cpp = scan("cpp", 'int a() { auto s = R"x(int no() { )" )x"; return 1\'000; }\nint b() { char c = \'{\'; return c; }\n')
    assert [f["name"] for f in cpp["function"]] == ["a", "b"]
    script = scan("javascript", "function a() { return /[/{\"]+/.test(x); }\nfunction b() { const r = /\\/{/g; return 4 / 2 / 1; }\n")
    assert [(f["name"], f["line_end"]) for f in script["function"]] == [("a", 1), ("b", 2)]
    java = scan("java", 'class A {\n  String t() { return """\n    void no() { "x" }\n    """; }\n  char c() { return \'}\'; }\n}\n')
    assert [f["name"] for f in java["function"]] == ["t", "c"]
    sharp = scan("csharp", 'class A {\n  string t() { return @"a "" { \\"; }\n  int u() { return 1; }\n}\n')
    assert [f["name"] for f in sharp["function"]] == ["t", "u"]
    go = scan("go", "func a() string { return `func no() { \\` }\nfunc b() {}\n")
    assert [f["name"] for f in go["function"]] == ["a", "b"]
