"""License scans by template markup.

A template is a text in the public template markup: ``<<beginOptional>>...<<endOptional>>`` encloses wording that may be
missing, and ``<<var;name="..";original="..";match="RE">>`` stands for wording that may be replaced. Both compile, with the
mandatory wording, into a token automaton; a text holds the license wherever the automaton accepts a run of its tokens, so
mandatory wording must match token by token and optional regions wholly or not at all. Templates hold the whole wording of
their licenses; those whose names end in -notice, -header or -tag are the notices that refer to one.

What a variable takes: ``.{a,b}`` so many tokens at most, and none only if a is 0; ``.+`` and ``.*`` any number; anything else
is a pattern of one token. Tokens are runs of letters and digits, joined by inner ``.``, ``-`` or ``'``, in lower case; white
space and other signs between them do not count, as matching guidelines ask.

Defined cases: null and empty texts hold no license; a license that occurs several times, without overlap, counts as
often; of two accepted runs that begin at one token the longer counts; repeated documents and null ids give rows of their
own; an empty table gives an empty result; further columns are not read. Whole texts are scanned, of any length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import workers_see_package

TOKEN = re.compile(r"[^\W_]+(?:[.\-'][^\W_]+)*")
MARK = re.compile(r"<<beginOptional(?:;[^>]*)?>>|<<endOptional>>|<<var;(.*?)>>", re.S)
_MATCH = re.compile(r'match="([^"]*)"')
_ANY = re.compile(r"\.\{(\d+),(\d+)\}")
#: Mandatory tokens at least so long are good filters: few other texts have them.
LONG_TOKEN = 12


@cache
def templates() -> dict[str, str]:
    """The templates beside this module, by name."""
    return {p.stem: p.read_text() for p in sorted(Path(__file__).with_name("templates").glob("*.txt"))}


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def variable(mark: str) -> tuple[str | None, int, int | None]:
    """(pattern of a token or None for any, least number of tokens, greatest or None) of a variable's attributes."""
    found = _MATCH.search(mark)
    if not found:
        raise ValueError(f"a variable without match: {mark}")
    if found[1] in (".+", ".*"):
        return None, int(found[1] == ".+"), None
    if m := _ANY.fullmatch(found[1]):
        return None, min(int(m[1]), 1), int(m[2])
    return found[1], 1, 1


def _fits(p: str | re.Pattern | None, word: str) -> bool:
    return p is None or (p == word if isinstance(p, str) else bool(p.fullmatch(word)))


class Automaton:
    """A nondeterministic token automaton; states are numbered along the template."""

    def __init__(self, template: str):
        self.edges: list[list[tuple[str | re.Pattern | None, int]]] = [[]]
        self.skips: list[list[int]] = [[]]
        opened: list[int] = []
        pos = 0
        for m in MARK.finditer(template):
            self._literal(template[pos : m.start()])
            pos = m.end()
            if m[0].startswith("<<begin"):
                opened.append(self._state())
                self.skips[-2].append(len(self.edges) - 1)
            elif m[0] == "<<endOptional>>":
                self._state()
                self.skips[-2].append(len(self.edges) - 1)
                self.skips[opened.pop()].append(len(self.edges) - 1)
            else:
                pattern, least, most = variable(m[1])
                predicate = pattern and re.compile(pattern, re.I)
                begin = len(self.edges) - 1
                for _ in range(most or 1):
                    self.edges[-1].append((predicate, self._state()))
                end = len(self.edges) - 1
                if most is None:
                    self.edges[end].append((predicate, end))
                for at in range(begin if least == 0 else begin + 1, end):
                    self.skips[at].append(end)
        if opened:
            raise ValueError("an optional region is not closed")
        self._literal(template[pos:])
        self.final = len(self.edges) - 1
        self.start = self._closure({0})
        if self.final in self.start:
            raise ValueError("a template needs mandatory wording")
        anchors = {p for s in self.start for p, _ in self.edges[s]}
        if None in anchors:
            raise ValueError("a template can't begin with any token")
        self.firsts, self.patterns = {p for p in anchors if isinstance(p, str)}, [p for p in anchors if not isinstance(p, str)]

    def _state(self) -> int:
        self.edges.append([])
        self.skips.append([])
        return len(self.edges) - 1

    def _literal(self, text: str) -> None:
        for t in tokens(text):
            here = len(self.edges) - 1
            self.edges[here].append((t, self._state()))

    def _closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def match(self, words: list[str], at: int) -> int:
        """The end of the longest accepted run that begins at ``at``, or -1."""
        states, end = self.start, -1
        for k in range(at, len(words)):
            w = words[k]
            states = {to for s in states for p, to in self.edges[s] if _fits(p, w)}
            if not states:
                break
            states = self._closure(states)
            if self.final in states:
                end = k + 1
        return end

    def count(self, words: list[str]) -> int:
        n = at = 0
        while at < len(words):
            end = self.match(words, at) if words[at] in self.firsts or any(_fits(p, words[at]) for p in self.patterns) else -1
            n, at = (n + 1, end) if end > 0 else (n, at + 1)
        return n


def mandatory(template: str) -> list[str]:
    """The tokens outside optional and replaceable regions."""
    depth, out, pos = 0, [], 0
    for m in [*MARK.finditer(template), None]:
        if not depth:
            out += tokens(template[pos : m.start() if m else None])
        if m:
            depth += 1 if m[0].startswith("<<begin") else -1 if m[0] == "<<endOptional>>" else 0
            pos = m.end()
    return out


def needed(of: dict[str, str]) -> dict[str, str]:
    """A mandatory token for each template, without which no text can be accepted; few and long ones for all together."""
    left = {k: {t for t in mandatory(v) if len(t) >= LONG_TOKEN} or {max(mandatory(v), key=len)} for k, v in of.items()}
    out: dict[str, str] = {}
    while left:
        best = max(sorted({t for own in left.values() for t in own}), key=lambda t: (sum(t in own for own in left.values()), len(t)))
        out |= dict.fromkeys([k for k, own in left.items() if best in own], best)
        left = {k: own for k, own in left.items() if best not in own}
    return out


def scan(df: DataFrame, of: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license_id, n_matches) for every license that a document holds.

    The JVM passes on only texts with a token that some template needs.
    """
    workers_see_package(df.sparkSession)
    of = templates() if of is None else of
    wanted = needed(of)
    low = F.lower("text")
    held = df.select("doc_id", "text").where(reduce(lambda a, b: a | b, (low.contains(x) for x in sorted(set(wanted.values())))))
    schema = T.StructType([T.StructField("doc_id", df.schema["doc_id"].dataType), T.StructField("license_id", T.StringType()), T.StructField("n_matches", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = {k: Automaton(t) for k, t in sorted(of.items())}
        for b in batches:
            rows, names, counts = [], [], []
            for i in range(b.num_rows):
                text = b.column(1)[i].as_py().lower()
                there = {x for x in set(wanted.values()) if x in text}
                words = tokens(text)
                for k, a in automata.items():
                    if wanted[k] in there and (n := a.count(words)):
                        rows.append(i)
                        names.append(k)
                        counts.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int32())), pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=schema.names)

    return held.mapInArrow(run, schema)


def as_regex(template: str) -> str:
    """A regular expression with the same matches, over tokens that each stand between two spaces of their own."""
    out, pos = [], 0

    def literal(text: str) -> str:
        return "".join(f" {re.escape(t)} " for t in tokens(text)).replace("\\-", "-")

    for m in MARK.finditer(template):
        out.append(literal(template[pos : m.start()]))
        pos = m.end()
        if m[0].startswith("<<begin"):
            out.append("(?:")
        elif m[0] == "<<endOptional>>":
            out.append(")?")
        else:
            pattern, least, most = variable(m[1])
            out.append(f"(?: {'[^ ]+' if pattern is None else f'(?:{pattern})'} ){{{least},{'' if most is None else most}}}")
    out.append(literal(template[pos:]))
    return "".join(out)


def oracle_sql() -> str:
    parts = []
    for name, t in templates().items():
        found = "regexp_extract_all(t, '" + as_regex(t).replace("'", "''") + "')"
        parts.append(f"select doc_id, '{name}' as license_id, len({found})::bigint as n_matches from spaced where contains(t, ' {max(mandatory(t), key=len).replace(chr(39), chr(39) * 2)} ')")
    return (
        "with spaced as (select doc_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]*([\\p{L}\\p{N}]+(?:[.\\-''][\\p{L}\\p{N}]+)*)[^\\p{L}\\p{N}]*', ' \\1 ', 'g') as t from documents)\n"
        "select * from (" + "\nunion all ".join(parts) + ") where n_matches > 0"
    )
