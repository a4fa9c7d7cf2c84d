"""Count transducers: weighted acyclic automata that map sequences of words to counts.

The weight of a sequence is on the arc that reads its last word. Automata are built from sorted
sequences without ever holding the trie: as soon as no further sequence can pass a state, the
state is replaced by a registered one with the same arcs, weights and targets.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np

#: Sizes in front of a stored automaton.
_HEAD = "<5q"


class Builder:
    """States by number; state 0 has no arcs. Arcs are flat tuples of label, weight, target."""

    def __init__(self):
        self.states: list[tuple] = [()]
        self._register: dict[tuple, int] = {(): 0}
        self._path: list[list] = [[]]

    def state(self, arcs: Sequence[int]) -> int:
        key = tuple(arcs)
        found = self._register.get(key)
        if found is None:
            found = self._register[key] = len(self.states)
            self.states.append(key)
        return found

    def _close(self, depth: int) -> None:
        path = self._path
        while len(path) > depth + 1:
            arcs = path.pop()
            path[-1][-1] = self.state(arcs)

    def add(self, shared: int, tail: Sequence[int], weight: int) -> None:
        """The next sequence: the first ``shared`` labels of the one before, then ``tail``, of
        one label at least. Sequences come in ascending order."""
        path = self._path
        if len(path) > shared + 1:
            self._close(shared)
        for label in tail:
            path[-1] += (label, 0, 0)
            path.append([])
        path[-2][-2] = weight

    def finish(self) -> int:
        """The start state."""
        self._close(0)
        return self.state(self._path[0])


class Transducer:
    def __init__(self, words: list[bytes], first: np.ndarray, arcs: np.ndarray, start: int):
        # arcs: label, weight and target in three columns; words ascend
        self.words, self.first, self.arcs, self.start = words, first, arcs, start

    @staticmethod
    def of(builder: Builder, start: int, words: Sequence[bytes]) -> Transducer:
        """The builder's automaton; ``words`` names its labels in ascending order. Words that
        no arc reads are left out."""
        sizes = [len(s) // 3 for s in builder.states]
        flat = np.fromiter(chain.from_iterable(builder.states), dtype=np.int64).reshape(-1, 3)
        used, flat[:, 0] = np.unique(flat[:, 0], return_inverse=True)
        return Transducer([words[i] for i in used.tolist()], np.cumsum([0, *sizes]), flat, start)

    @staticmethod
    def from_sorted(words: Sequence[bytes], grams: Iterable[tuple[int, Sequence[int], int]]) -> Transducer:
        """From (shared, tail, weight) as ``Builder.add`` takes them."""
        builder = Builder()
        for shared, tail, weight in grams:
            builder.add(shared, tail, weight)
        return Transducer.of(builder, builder.finish(), words)

    @staticmethod
    def from_counts(counts: dict[tuple[bytes, ...], int]) -> Transducer:
        words = sorted({w for gram in counts for w in gram})
        number = {w: i for i, w in enumerate(words)}
        before: tuple = ()
        grams = []
        for gram in sorted(counts):
            shared = next((i for i, (a, b) in enumerate(zip(before, gram)) if a != b), min(len(before), len(gram)))
            grams.append((shared, [number[w] for w in gram[shared:]], counts[gram]))
            before = gram
        return Transducer.from_sorted(words, grams)

    def to_bytes(self) -> bytes:
        names = b"\n".join(self.words)
        arcs = self.arcs
        return b"".join([
            struct.pack(_HEAD, len(self.first), len(arcs), self.start, len(self.words), len(names)),
            self.first.astype("<i4").tobytes(), arcs[:, 0].astype("<i4").tobytes(),
            arcs[:, 1].astype("<i8").tobytes(), arcs[:, 2].astype("<i4").tobytes(), names,
        ])

    @staticmethod
    def from_bytes(data: bytes) -> Transducer:
        n_first, n_arcs, start, n_words, n_names = struct.unpack_from(_HEAD, data)
        at, columns = struct.calcsize(_HEAD), []
        for kind, n in (("<i4", n_first), ("<i4", n_arcs), ("<i8", n_arcs), ("<i4", n_arcs)):
            columns.append(np.frombuffer(data, dtype=kind, count=n, offset=at).astype(np.int64))
            at += n * int(kind[2])
        words = data[at : at + n_names].split(b"\n") if n_words else []
        return Transducer(words, columns[0], np.stack(columns[1:], axis=1), start)

    def tables(self) -> list[list[tuple[int, int, int]]]:
        """The arcs of each state."""
        arcs, first = list(map(tuple, self.arcs.tolist())), self.first.tolist()
        return [arcs[a:b] for a, b in zip(first[:-1], first[1:])]

    def items(self) -> Iterator[tuple[tuple[bytes, ...], int]]:
        """All sequences with a weight, in ascending order."""
        states, words = self.tables(), self.words

        def walk(state: int, before: tuple) -> Iterator:
            for label, weight, target in states[state]:
                gram = (*before, words[label])
                if weight:
                    yield gram, weight
                if target:
                    yield from walk(target, gram)

        yield from walk(self.start, ())


def union(parts: Sequence[Transducer], least: int = 1) -> Transducer:
    """The automaton of all sequences, with weights summed; those below ``least`` are left out.
    All automata are walked at once, arc by arc."""
    words = sorted(set().union(*[t.words for t in parts]))
    number = {w: i for i, w in enumerate(words)}
    tables = []
    for t in parts:
        names = [number[w] for w in t.words]
        tables.append([[(names[a], w, to) for a, w, to in arcs] for arcs in t.tables()])
    builder = Builder()
    copied: dict[tuple[int, int], int] = {}

    def walk(states: list[tuple[int, int]]) -> int:
        alone = states[0] if len(states) == 1 else None
        if alone in copied:
            return copied[alone]
        met: dict[int, list] = {}
        for part, state in states:
            for label, weight, target in tables[part][state]:
                entry = met.get(label)
                if entry is None:
                    met[label] = [weight, [(part, target)] if target else []]
                else:
                    entry[0] += weight
                    if target:
                        entry[1].append((part, target))
        arcs: list[int] = []
        for label in sorted(met):
            weight, below = met[label]
            target = walk(below) if below else 0
            if weight < least:
                weight = 0
            if weight or target:
                arcs += (label, weight, target)
        made = builder.state(arcs)
        if alone is not None:
            copied[alone] = made
        return made

    start = walk([(k, t.start) for k, t in enumerate(parts)])
    return Transducer.of(builder, start, words)


def compose(asked: Transducer, counts: Transducer) -> Iterator[tuple[tuple[bytes, ...], int]]:
    """The sequences that ``asked`` accepts with their weights in ``counts``, where they have
    one: both are walked together, over arcs that read the same word."""
    a_states, b_states = asked.tables(), counts.tables()
    number = {w: i for i, w in enumerate(counts.words)}
    names = [number.get(w, -1) for w in asked.words]
    maps: dict[int, dict[int, tuple[int, int]]] = {}

    def walk(a: int, b: int, before: tuple) -> Iterator:
        if b not in maps:
            maps[b] = {label: (weight, target) for label, weight, target in b_states[b]}
        here = maps[b]
        for label, wanted, a_next in a_states[a]:
            met = here.get(names[label])
            if met is not None:
                gram = (*before, asked.words[label])
                if wanted and met[0]:
                    yield gram, met[0]
                if a_next and met[1]:
                    yield from walk(a_next, met[1], gram)

    yield from walk(asked.start, counts.start, ())
