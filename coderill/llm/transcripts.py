"""Transcript parsing: roles by a hidden Markov model, then canonical turns.

A transcript is plain text in which turns may open with a speaker marker of some fashion ("User:", "### Response:", "[sam]",
"**AI**:") or with none. Each line is one observation of several features: the marker's name if it is in the LEXICON and
labelled transcripts have it, else how it relates to those before it; blank line before; last sign; length; list, quote or
code look. Hidden states are (role, opens a turn) and (role, goes on), so a line that goes on keeps its role. Start, transition and feature
probabilities are counted over labelled transcripts and smoothed, features being independent given the state; Viterbi then
recovers the roles of all lines at once, and each opening line begins a canonical turn. Blank lines inside a turn stay as they
are; those between turns, which only set them apart, go.

The counts are sufficient: a few hundred rows leave the executors whatever the number of transcripts.

Defined cases: a null transcript has null roles and a null chat; an empty one has no turn and an empty chat; rows that repeat
conversation, turn, role and text are one turn; turns of equal number go in the order of role, then text; a null conv_id is
a conversation of its own; a null role teaches nothing, a null text is an empty turn; without any labelled line every
transcript is one turn of the role "unknown"; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import string_array, workers_see_package

#: Names that have a symbol of their own; all others are told apart only by how they relate to each other.
LEXICON = tuple("user human assistant ai bot model system instruction response input output question answer q a note prompt agent customer client".split())
MARKER = re.compile(r"^\s{0,3}(?:#{1,6}\s*([^\W\d_][\w .\-]{0,30}?)\s*:?\s*$|\*\*([^\W\d_][\w .\-]{0,30}?)\*\*\s*:\s?|\[([^\W\d_][\w .\-]{0,30}?)\]\s*:?\s?|<([^\W\d_][\w .\-]{0,30}?)>\s*:?\s?|([^\W\d_][\w.\-]{0,20}(?: [\w.\-]{1,12})?):(?:\s|$))")
FEATURES = ("marker", "blank_before", "last_sign", "length", "look")
NAMES = ("alex", "sam", "kim", "robin", "lee", "jo")
#: Lines that what is known of all states counts as, against those of one state.
POOL = 3.0
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def transcripts_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, transcript, turns) as people would have pasted ``conversations``: one of six fashions of markers for each
    conversation, and about every tenth turn but the first without any. turns: (role, text as it stands in the transcript)."""
    conv = F.col("conv_id")
    unique = F.array_sort(F.collect_set(F.struct(F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    chats = conversations.groupBy(conv.alias("conv_id")).agg(unique.alias("t")).withColumn("h", F.xxhash64(F.lit(3), "conv_id"))
    style = F.pmod("h", F.lit(6))

    def name(x, plain: tuple[str, str, str]):
        return F.when(x["role"] == "assistant", plain[1]).when(x["role"] == "system", plain[2]).otherwise(plain[0])

    def person(x, shift: int):
        return F.element_at(F.array(*(F.lit(n) for n in NAMES)), (F.pmod(F.shiftright("h", 8), F.lit(3)) * 2 + shift).cast("int"))

    def render(x, i):
        text = x["text"]
        marked = (
            F.when(style == 0, F.concat(name(x, ("User", "Assistant", "System")), F.lit(": "), text))
            .when(style == 1, F.concat(name(x, ("Human", "AI", "System")), F.lit(": "), text))
            .when(style == 2, F.concat(F.lit("### "), name(x, ("Instruction", "Response", "System")), F.lit(":\n"), text))
            .when(style == 3, F.concat(name(x, ("Q", "A", "Note")), F.lit(": "), text))
            .when(style == 4, F.concat(F.lit("["), F.when(x["role"] == "assistant", person(x, 2)).when(x["role"] == "system", "system").otherwise(person(x, 1)), F.lit("] "), text))
            .otherwise(F.concat(F.lit("**"), name(x, ("User", "Bot", "System")), F.lit("**: "), text))
        )
        bare = (i > 0) & (F.pmod(F.xxhash64(F.lit(9), F.col("h"), i), F.lit(10)) == 0)
        return F.struct(x["role"].alias("role"), F.when(bare, text).otherwise(marked).alias("text"))

    turns = chats.select("conv_id", "h", F.transform("t", render).alias("turns"))
    gap = F.when(F.pmod("h", F.lit(2)) == 0, F.lit("\n")).otherwise(F.lit("\n\n"))
    return turns.select("conv_id", F.array_join(F.col("turns.text"), "\n\n").alias("wide"), F.array_join(F.col("turns.text"), "\n").alias("narrow"), gap.alias("gap"), "turns").select(
        "conv_id", F.when(F.col("gap") == "\n", F.col("narrow")).otherwise(F.col("wide")).alias("transcript"), F.col("gap"), "turns"
    )


def observe(transcript: str) -> list[tuple[str, tuple[str, ...], str, list[str], str]]:
    """(line, features, line without its marker, blank lines before it, how its marker relates to others) of each line that isn't blank."""
    out, blank, first_name, last_name, gap = [], True, None, None, []
    for line in transcript.split("\n"):
        if not line.strip():
            blank = True
            gap.append(line)
            continue
        m = MARKER.match(line)
        symbol, rest, relation = "none", line, "none"
        if m:
            own = next(g for g in m.groups() if g).strip().lower()
            rest = line[m.end() :]
            relation = "new" if first_name is None else "same" if own == last_name else "first" if own == first_name else "other"
            symbol = own if own in LEXICON else relation
            first_name, last_name = first_name or own, own
        tail = rest.rstrip()[-1:] or "nothing"
        n = len(line)
        look = "code" if line.startswith(("    ", "\t", "```")) else "list" if re.match(r"\s*(?:[-*+]|\d+[.)])\s", line) else "quote" if line.startswith(">") else "upper" if rest[:1].isupper() else "plain"
        last = tail if tail in ".?!:,;" or tail == "nothing" else "other"
        out.append((line, (symbol, str(blank), last, str(n.bit_length()), look), rest, gap, relation))
        blank, gap = False, []
    return out


@dataclass
class Model:
    """Log-probabilities. States are 2 * role (opens a turn) and 2 * role + 1 (goes on)."""

    roles: list[str]
    start: np.ndarray
    move: np.ndarray
    emit: list[dict[str, np.ndarray]]
    unseen: list[np.ndarray]

    def decode(self, observed: list[tuple]) -> list[int]:
        """The most probable states, by Viterbi; ties go to the first state."""
        return self.decode_all([observed])[0]

    def decode_all(self, many: list[list[tuple]]) -> list[list[int]]:
        """The most probable states of all sequences, a step of all of them at a time."""
        numbers: dict[tuple[str, ...], int] = {}
        size = np.array([len(o) for o in many], np.int64)
        # a name that no labelled transcript has is told by how it relates to others, as unknown ones are
        flat = np.array([numbers.setdefault(x[1] if x[1][0] in self.emit[0] else (x[-1], *x[1][1:]), len(numbers)) for o in many for x in o], np.int64)
        if not len(flat):
            return [[] for _ in many]
        table = np.stack([sum(self.emit[k].get(f, self.unseen[k]) for k, f in enumerate(features)) for features in numbers])
        begin = np.concatenate([[0], np.cumsum(size)])[:-1]
        # longest first: those that still go on are always the first ones
        order = np.argsort(-size, kind="stable")
        alive = np.searchsorted(-size[order], -np.arange(size.max()), side="left")
        best, back = self.start + table[flat[begin[order[: alive[0]]]]], []
        for t in range(1, len(alive)):
            n = alive[t]
            way = best[:n, :, None] + self.move
            back.append(way.argmax(1).astype(np.int16))
            best[:n] = way.max(1) + table[flat[begin[order[:n]] + t]]
        states = np.empty(len(flat), np.int64)
        now = np.zeros(len(order), np.int64)
        for t in range(len(alive) - 1, -1, -1):
            n, later = alive[t], alive[t + 1] if t + 1 < len(alive) else 0
            if later:
                now[:later] = back[t][np.arange(later), now[:later]]
            now[later:n] = best[later:n].argmax(1)
            states[begin[order[:n]] + t] = now[:n]
        return [states[b : b + k].tolist() for b, k in zip(begin, size, strict=True)]

    def turns(self, transcript: str) -> list[tuple[str, str]]:
        """(role, text) of each turn."""
        return self.turns_all([transcript])[0]

    def turns_all(self, transcripts: list[str]) -> list[list[tuple[str, str]]]:
        many = [observe(t) for t in transcripts]
        found = []
        for observed, states in zip(many, self.decode_all(many), strict=True):
            out: list[tuple[str, list[str]]] = []
            for (line, _, rest, gap, _), state in zip(observed, states, strict=True):
                if state % 2 == 0 or not out:
                    out.append((self.roles[state // 2], [rest] if rest.strip() else []))
                else:
                    out[-1][1].extend([*gap, line])
            found.append([(r, "\n".join(x)) for r, x in out])
        return found


def _state_of(roles: list[str], role: str, goes_on: bool) -> int:
    return 2 * roles.index(role) + goes_on


def fit(transcripts: DataFrame) -> Model:
    """From the turns of transcripts_of(); counts leave the executors, one row a symbol and state."""
    workers_see_package(transcripts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for turns, gap in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                labels = []
                for turn in turns:
                    own = [x for x in (turn["text"] or "").split("\n") if x.strip()]
                    labels += [(turn["role"], k > 0) for k in range(len(own))]
                observed = observe(gap.join(t["text"] or "" for t in turns))
                before = None
                for (role, goes_on), (_, features, *_, relation) in zip(labels, observed, strict=True):
                    state = None if role is None else f"{int(goes_on)}{role}"
                    if state is not None:
                        counts["start" if before is None else "move", before or "", state] += 1
                        for k, f in enumerate(features):
                            counts[FEATURES[k], f, state] += 1
                        if features[0] != relation:  # known names teach how unknown ones go
                            counts[FEATURES[0], relation, state] += 1
                    before = state
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in counts], pa.string()) for i in range(3)] + [pa.array(list(counts.values()), pa.int64())], names=["kind", "a", "b", "n"])

    found = transcripts.select("turns", "gap").mapInArrow(run, "kind string, a string, b string, n bigint").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()
    return model_of([tuple(r) for r in found])


def model_of(counts: list[tuple[str, str, str, int]]) -> Model:
    roles = sorted({b[1:] for _, _, b, _ in counts}) or ["unknown"]
    states = 2 * len(roles)
    place = {f"{k}{r}": _state_of(roles, r, bool(k)) for r in roles for k in (0, 1)}
    start, move = np.zeros(states), np.zeros((states, states))
    seen: list[dict[str, np.ndarray]] = [{} for _ in FEATURES]
    for kind, a, b, n in counts:
        if kind == "start":
            start[place[b]] += n
        elif kind == "move":
            move[place[a], place[b]] += n
        else:
            seen[FEATURES.index(kind)].setdefault(a, np.zeros(states))[place[b]] += n
    # only an opening line can come first or change the role
    opens = np.arange(states) % 2 == 0
    allowed = opens[None, :] | (np.arange(states)[:, None] // 2 == np.arange(states)[None, :] // 2)
    with np.errstate(divide="ignore"):
        start = np.log(np.where(opens, start + 1, 0) / (start + 1)[opens].sum())
        move = np.where(allowed, move + 1, 0)
        move = np.log(move / move.sum(1, keepdims=True))
    emit, unseen = [], []
    for k in range(len(FEATURES)):
        # a state is smoothed by all that open a turn, or all that go on; these by one of each symbol and one unseen
        total = sum(seen[k].values(), np.zeros(states))
        pooled = lambda n: np.where(opens, n[opens].sum(), n[~opens].sum())
        share = lambda n: (pooled(n) + 1) / (pooled(total) + len(seen[k]) + 1)
        emit.append({a: np.log((n + POOL * share(n)) / (total + POOL)) for a, n in seen[k].items()})
        unseen.append(np.log(POOL * share(np.zeros(states)) / (total + POOL)))
    return Model(roles, start, move, emit, unseen)


def render(turns: list[tuple[str, str]]) -> str:
    """Canonical turns; what looks like one of their own marks inside a text is broken up."""
    return "".join(f"{OPEN}{role}\n{text.strip().replace('<|', '< |')}{CLOSE}\n" for role, text in turns)


def parse(transcripts: DataFrame, model: Model) -> DataFrame:
    """conv_id, n_turns, roles and chat, one row for each transcript."""
    workers_see_package(transcripts.sparkSession)
    shared = transcripts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = string_array(b.column(1)).to_pylist()
            found = iter(shared.value.turns_all([t for t in texts if t is not None]))
            turns = [None if t is None else next(found) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).cast(pa.int64()),
                    pa.array([None if t is None else len(t) for t in turns], pa.int64()),
                    pa.array([None if t is None else [r for r, _ in t] for t in turns], pa.list_(pa.string())),
                    pa.array([None if t is None else render(t) for t in turns], pa.string()),
                ],
                names=["conv_id", "n_turns", "roles", "chat"],
            )

    return transcripts.select("conv_id", "transcript").mapInArrow(run, "conv_id bigint, n_turns bigint, roles array<string>, chat string")
