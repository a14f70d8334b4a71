"""Matching many phrases in one pass: an Aho-Corasick automaton as a table of states, which many texts walk in step."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import slices

#: Texts are walked in segments of so many characters, each with a run-up of one character less than the longest phrase.
SEGMENT = 512
#: Characters of the texts that are walked at a time.
GROUP = 2_000_000


class Automaton:
    """States are numbered from 0, the root; `step` has a row for each state and a column for each character class. Class 0 holds all characters that no phrase has, and leads to the root."""

    def __init__(self, phrases: list[str]):
        import numpy as np

        self.phrases = list(dict.fromkeys(phrases))
        letters = sorted({ord(c) for p in self.phrases for c in p})
        self.classes = np.zeros(max(letters, default=0) + 2, np.int32)
        self.classes[letters] = np.arange(1, len(letters) + 1)
        children, ends = [{}], [[]]
        for number, phrase in enumerate(self.phrases):
            state = 0
            for c in phrase:
                state = children[state].setdefault(int(self.classes[ord(c)]), len(children))
                if state == len(children):
                    children.append({})
                    ends.append([])
            if state:
                ends[state].append(number)
        self.step = np.zeros((len(children), len(letters) + 1), np.int32)
        shorter = [0] * len(children)  # the state of the longest proper suffix that is the beginning of a phrase
        waiting = deque([0])
        while waiting:
            state = waiting.popleft()
            if state:
                ends[state] = ends[state] + ends[shorter[state]]
                self.step[state] = self.step[shorter[state]]
            for c, child in children[state].items():
                shorter[child] = int(self.step[shorter[state], c]) if state else 0
                self.step[state, c] = child
                waiting.append(child)
        self.ends = ends
        self.final = np.array([bool(e) for e in ends])
        self.longest = max(map(len, self.phrases), default=0)

    def found(self, texts: list[str]):
        """(text, phrase): the numbers of all phrases in each text, each once; the empty phrase is in none."""
        import numpy as np

        out = [np.zeros(0, np.int64)]
        start = size = 0
        for k, t in enumerate(texts):
            size += len(t)
            if size >= GROUP or k == len(texts) - 1:
                out.append(self._walked(texts[start : k + 1]) + start * len(self.ends))
                start, size = k + 1, 0
        text, state = np.divmod(np.concatenate(out), len(self.ends))
        counts = np.array([len(self.ends[s]) for s in state.tolist()], np.int64)
        phrase = np.fromiter((p for s in state.tolist() for p in self.ends[s]), np.int64, int(counts.sum()))
        both = np.unique(np.repeat(text, counts) * max(1, len(self.phrases)) + phrase)
        return np.divmod(both, max(1, len(self.phrases)))

    def _walked(self, texts: list[str]):
        """The states with phrases that each text reaches, as text * states + state."""
        import numpy as np

        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.classes[np.minimum(codes, len(self.classes) - 1)]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        parts = -(-sizes // SEGMENT)
        text = np.repeat(np.arange(len(texts)), parts)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = np.repeat(np.cumsum(sizes) - sizes, parts)
        low = begin + np.maximum(0, nth * SEGMENT - (self.longest - 1))
        high = begin + np.minimum((nth + 1) * SEGMENT, sizes[text])
        order = np.argsort(low - high, kind="stable")  # the longest first, so that those under way are a prefix
        text, low, length = text[order], low[order], (high - low)[order]
        state, step, width, reached = np.zeros(len(text), np.int64), self.step.reshape(-1), self.step.shape[1], [np.zeros(0, np.int64)]
        active = len(text)
        for j in range(int(length.max(initial=0))):
            while active and length[active - 1] <= j:
                active -= 1
            state[:active] = step[state[:active] * width + kind[low[:active] + j]]
            at = np.flatnonzero(self.final[state[:active]])
            if len(at):
                reached.append(text[at] * len(self.ends) + state[at])
        return np.unique(np.concatenate(reached))


def first_of(lists: list[list[str]]):
    """A function of a text column: for each list the place of its first phrase, in the list's order, that the text holds; -1 if none. The empty phrase is in every text."""
    import numpy as np

    machine = Automaton([p for phrases in lists for p in phrases if p])
    number = {p: k for k, p in enumerate(machine.phrases)}
    uses = sorted((number[p], l, k) for l, phrases in enumerate(lists) for k, p in enumerate(phrases) if p)
    owner, which, place = (np.array([u[i] for u in uses], np.int64) for i in range(3))
    first, last = np.searchsorted(owner, np.arange(len(number))), np.searchsorted(owner, np.arange(len(number)), side="right")
    none = max(map(len, lists), default=0)
    start = [phrases.index("") if "" in phrases else none for phrases in lists]

    def run(texts):
        import pyarrow as pa

        parts = [places_of([t or "" for t in part.to_pylist()]) for part in slices(texts)]
        best = np.concatenate([np.zeros((0, len(lists)), np.int32), *parts])
        return pa.ListArray.from_arrays(pa.array(np.arange(0, best.size + 1, max(1, len(lists))), pa.int32()), pa.array(best.reshape(-1)))

    def places_of(texts: list[str]):
        text, phrase = machine.found(texts)
        n = last[phrase] - first[phrase]
        use = np.repeat(first[phrase] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        best = np.tile(np.array(start, np.int32), (len(texts), 1))
        np.minimum.at(best, (np.repeat(text, n), which[use]), place[use].astype(np.int32))
        best[best == none] = -1
        return best

    def of(text: Column) -> Column:
        return F.arrow_udf(run, "array<int>")(text)

    return of
