"""Secret scan by one combined deterministic automaton.

The rules' regexes are parsed, reversed and joined to one non-deterministic automaton over bytes, made deterministic by
subset construction and minimised by partition refinement; the result is one transition array, (state, byte class) ->
state. It reads the bytes once, from the last to the first, for all rules: wherever it accepts, a match of the rules that
the state names begins. All texts of a batch are one byte sequence that is cut into many lanes of equal length; the lanes
advance together, one gathered array per byte step, and a lane that began in the wrong state is run again from its true
state until both runs meet. A rule's first start, and the first one after each of its matches, is then read forwards by the
rule's own small automaton to the longest end. Every such reading is a match, so all of them together take as long as the text.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandweave.llm.textkernel import pieces, text_buffer


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``regex`` whose value (what follows the separator, over the class ``value``), or which
    as a whole, have ``least`` characters."""

    kind: str
    regex: str
    least: int = 1
    value: str | None = None


def _either_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "apikey", "api_key"))
_LEAD = rf"""({_KEYS})["']? *[:=] *["']?[A-Za-z0-9+/_.=-]"""
_B64 = "[A-Za-z0-9_-]"
#: The base kinds in the order in which they sort, then those that this scan adds.
RULES = (
    Rule("assign", f"{_LEAD}[A-Za-z0-9+/_.=-]*", 6, "[A-Za-z0-9+/_.=-]"),
    Rule("access", "AKIA[A-Z0-9]+", 20),
    Rule("hex", "[0-9a-f]{24}[0-9a-f]*", 24),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("google", f"AIza{_B64}+", 39),
    Rule("stripe", "[rs]k_(live|test)_[A-Za-z0-9]+", 24),
    Rule("jwt", rf"eyJ{_B64}+\.eyJ{_B64}+\.{_B64}+", 30),
    Rule("pem", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")


# --- regex to automaton ---


def _class(text: str, k: int) -> tuple[frozenset[int], int]:
    out: set[int] = set()
    k += 1
    while text[k] != "]":
        lo = ord(text[k])
        if text[k + 1] == "-" and text[k + 2] != "]":
            out.update(range(lo, ord(text[k + 2]) + 1))
            k += 3
        else:
            out.add(lo)
            k += 1
    return frozenset(out), k + 1


def parse(text: str):
    """A tree of ("set", bytes), ("cat", parts), ("alt", parts), ("rep", part, least, unbounded, most); ASCII only."""

    def alternatives(k: int):
        parts = []
        while True:
            part, k = sequence(k)
            parts.append(part)
            if k == len(text) or text[k] == ")":
                return (parts[0] if len(parts) == 1 else ("alt", parts)), k
            k += 1

    def sequence(k: int):
        parts = []
        while k < len(text) and text[k] not in "|)":
            if text[k] == "(":
                atom, k = alternatives(k + 1)
                k += 1
            elif text[k] == "[":
                chars, k = _class(text, k)
                atom = ("set", chars)
            elif text[k] == "\\":
                atom, k = ("set", frozenset({ord(text[k + 1])})), k + 2
            else:
                atom, k = ("set", frozenset({ord(text[k])})), k + 1
            while k < len(text) and text[k] in "?*+{":
                if text[k] == "{":
                    end = text.index("}", k)
                    n = int(text[k + 1 : end])
                    atom, k = ("rep", atom, n, False, n), end + 1
                else:
                    atom, k = {"?": ("rep", atom, 0, False, 1), "*": ("rep", atom, 0, True, 0), "+": ("rep", atom, 1, True, 1)}[text[k]], k + 1
            parts.append(atom)
        return ("cat", parts), k

    tree, k = alternatives(0)
    if k != len(text):
        raise ValueError(f"unbalanced regex: {text}")
    return tree


def reverse(tree):
    kind = tree[0]
    if kind == "cat":
        return ("cat", [reverse(x) for x in reversed(tree[1])])
    if kind == "alt":
        return ("alt", [reverse(x) for x in tree[1]])
    return ("rep", reverse(tree[1]), *tree[2:]) if kind == "rep" else tree


class Nfa:
    def __init__(self):
        self.silent: list[list[int]] = []
        self.edge: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.silent.append([])
        self.edge.append(None)
        return len(self.edge) - 1

    def build(self, tree, start: int) -> int:
        kind = tree[0]
        if kind == "set":
            end = self.state()
            at = self.state()
            self.silent[start].append(at)
            self.edge[at] = (tree[1], end)
            return end
        if kind == "cat":
            for part in tree[1]:
                start = self.build(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for part in tree[1]:
                at = self.state()
                self.silent[start].append(at)
                self.silent[self.build(part, at)].append(end)
            return end
        _, part, least, unbounded, most = tree
        for _ in range(least):
            start = self.build(part, start)
        if unbounded:
            loop, end = self.state(), self.state()
            self.silent[start] += [loop, end]
            self.silent[self.build(part, loop)] += [loop, end]
            return end
        for _ in range(most - least):
            end = self.build(part, start)
            self.silent[start].append(end)
            start = end
        return start

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.silent[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


@dataclass(frozen=True)
class Dfa:
    """table[state, classes[byte]] is the next state; accepts[state] the bits of the rules that end there; 0 is the start."""

    classes: np.ndarray
    table: np.ndarray
    accepts: np.ndarray
    dead: int  #: a state that nothing leaves and that accepts nothing, or -1


def compile_rules(trees: list, anywhere: bool) -> Dfa:
    """Subset construction over byte classes, then minimisation. ``anywhere``: a match may begin at any byte."""
    nfa = Nfa()
    root, final = nfa.state(), {}
    for k, tree in enumerate(trees):
        at = nfa.state()
        nfa.silent[root].append(at)
        final[nfa.build(tree, at)] = 1 << k
    sets = sorted({e[0] for e in nfa.edge if e}, key=sorted)
    signature = [tuple(b in s for s in sets) for b in range(256)]
    known = {s: k for k, s in enumerate(dict.fromkeys(signature))}
    classes = np.array([known[s] for s in signature], np.uint8)
    sample = [signature.index(s) for s in known]
    begin = nfa.closure([root])
    ids, order, rows = {begin: 0}, [begin], []
    for states in order:  # grows meanwhile
        row = []
        edges = [nfa.edge[x] for x in states if nfa.edge[x]]
        for b in sample:
            to = nfa.closure([t for chars, t in edges if b in chars])
            to = to | begin if anywhere else to
            if to not in ids:
                ids[to] = len(order)
                order.append(to)
            row.append(ids[to])
        rows.append(row)
    table = np.array(rows, np.int64)
    accepts = np.array([sum(bit for f, bit in final.items() if f in s) for s in order], np.int64)
    group = np.unique(accepts, return_inverse=True)[1]
    while True:  # refine until the groups of the successors tell no states of a group apart
        _, finer = np.unique(np.column_stack([group, group[table]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == group.max():
            break
        group = finer
    first = np.unique(group, return_index=True)[1]
    name = np.empty(len(first), np.int64)
    name[group[np.sort(first)]] = np.arange(len(first))  # in order of discovery, so the start is 0
    small = np.zeros((len(first), len(known)), np.uint16)
    small[name[group[first]]] = name[group[table[first]]]
    out = np.zeros(len(first), np.int64)
    out[name[group[first]]] = accepts[first]
    stuck = np.flatnonzero((small == np.arange(len(small))[:, None]).all(1) & (out == 0))
    return Dfa(classes, small, out, int(stuck[0]) if len(stuck) and not anywhere else -1)


@dataclass(frozen=True)
class Scanner:
    rules: tuple[Rule, ...]
    backward: Dfa  #: of all rules: accepts at the first byte of a match
    forward: tuple[Dfa, ...]


@functools.lru_cache(4)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    trees = [parse(r.regex) for r in rules]
    return Scanner(rules, compile_rules([reverse(t) for t in trees], True), tuple(compile_rules([t], False) for t in trees))


# --- scanning ---

LANES = 2048


def accepting(dfa: Dfa, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, rule bits) of all bytes after which the automaton is in an accepting state."""
    n = len(data)
    width = dfa.table.shape[1]
    lanes = max(1, min(LANES, n // 64))
    length = -(-n // lanes)
    pad = np.zeros(lanes * length, np.uint8)
    pad[:n] = dfa.classes[data]
    steps = np.ascontiguousarray(pad.reshape(lanes, length).T)  # (step, lane)
    flat = (dfa.table.astype(np.int32) * width).ravel()  # a state is known by its row's offset
    state = np.zeros(lanes, np.int32)
    seen = np.empty((length, lanes), np.int32)
    for k in range(length):
        np.take(flat, state + steps[k], out=state)
        seen[k] = state
    for lane in range(1, lanes):
        s = int(seen[-1, lane - 1])
        for k in range(length if s else 0):  # the lane began in the start state, but its true one is s
            s = int(flat[s + int(steps[k, lane])])
            if s == seen[k, lane]:
                break
            seen[k, lane] = s
    accepts = np.zeros(len(flat), bool)
    accepts[::width] = dfa.accepts != 0
    k, lane = np.nonzero(accepts[seen])
    at = lane * length + k
    by = np.argsort(at, kind="stable")
    at, bits = at[by], dfa.accepts[seen[k, lane] // width][by]
    inside = at < n
    return at[inside], bits[inside]


def _longest(dfa: Dfa, data: bytes, at: int) -> int:
    """The last position at which the automaton accepts, read from ``at``; -1 if none."""
    classes, table, accepts, s, far = dfa.classes, dfa.table, dfa.accepts, 0, -1
    while at < len(data):
        s = int(table[s, classes[data[at]]])
        if s == dfa.dead:
            break
        at += 1
        if accepts[s]:
            far = at
    return far


def _value_length(rule: Rule, match: bytes) -> int:
    if rule.value is None:
        return len(match)
    chars, _ = _class(rule.value, 0)
    n = 0
    while n < len(match) and match[-1 - n] in chars:
        n += 1
    lead = re.match(rb"(?s).*?[:=] *[\"']?", match)  # the separator itself is in the class
    return min(n, len(match) - lead.end()) if lead else n


def find_spans(scan: Scanner, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """For each text, (start, rule number, end) in bytes: each rule's leftmost-longest non-overlapping matches that are long enough."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    if not len(data):
        return out
    # a byte that no rule matches between texts keeps matches from crossing the border
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    joined = np.full(len(data) + len(offsets) - 1, 0x0A, np.uint8)
    joined[np.arange(len(data)) + owner] = data
    begins = offsets[:-1] + np.arange(len(offsets) - 1)
    ends = begins + np.diff(offsets)
    at, bits = accepting(scan.backward, joined[::-1])
    if not len(at):
        return out
    at, bits = len(joined) - 1 - at[::-1], bits[::-1]
    text = np.searchsorted(begins, at, "right") - 1
    for doc in np.unique(text):
        raw = joined[begins[doc] : ends[doc]].tobytes()
        own = text == doc
        where, what = at[own] - begins[doc], bits[own]
        for number, rule in enumerate(scan.rules):
            free = 0
            for p in where[(what >> number) & 1 == 1].tolist():
                if p < free:
                    continue
                end = _longest(scan.forward[number], raw, p)
                if _value_length(rule, raw[p:end]) >= rule.least:
                    out[doc].append((p, number, end))
                free = end
        out[doc].sort()
    return out


def scan_column(column: pa.Array, rules: tuple[Rule, ...] = RULES) -> Iterator[list[tuple[str, int, int]]]:
    """For each text, (kind, start, end) in code points, by start, then in the rules' order."""
    scan = scanner(rules)
    data, offsets = text_buffer(column)
    for lo, hi in pieces(offsets):
        own = data[offsets[lo] : offsets[hi]]
        off = offsets[lo : hi + 1] - offsets[lo]
        for k, found in enumerate(find_spans(scan, own, off)):
            if not found:
                yield []
                continue
            points = np.concatenate([[0], np.cumsum((own[off[k] : off[k + 1]] & 0xC0) != 0x80)])
            yield [(rules[n].kind, int(points[a]), int(points[b])) for a, n, b in found]


SPANS = "array<struct<kind string, start long, end long>>"


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans) of each row: spans of secrets in the whole text, by start, then rule; code points, end exclusive.

    Null and empty texts have none; a null doc_id stays; repeated rows each give a row; spans of differing rules may
    overlap; an empty table gives no row; columns other than doc_id and text are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in scan_column(batch.column(1), rules)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def redact_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Every stretch that spans cover becomes one mark that names the first kind."""
    out, done, k = [], 0, 0
    while k < len(spans):
        kind, start, end = spans[k]
        k += 1
        while k < len(spans) and spans[k][1] < end:
            end = max(end, spans[k][2])
            k += 1
        out += [text[done:start], f"[{kind.upper()}]"]
        done = end
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` with every secret of ``text`` replaced by its kind in brackets, and n_chars counted anew.

    Nulls stay null, texts without secrets stay as they are, and all other columns pass unchanged.
    """
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            found = list(scan_column(column, rules))
            columns = list(batch.columns)
            if any(found):
                texts = column.to_pylist()
                new = [redact_text(t, s) if s else t for t, s in zip(texts, found, strict=True)]
                columns[at] = pa.array(new, column.type)
                if "n_chars" in names:
                    c = names.index("n_chars")
                    counts = [len(n) if s else o for n, s, o in zip(new, found, columns[c].to_pylist(), strict=True)]
                    columns[c] = pa.array(counts, columns[c].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
