"""Exact token counts at every prefix, by prefix dynamic programming.

Pieces never hold a space after another character, so a text is cut into units, each a run of spaces and what follows up to the
next space. Inside a unit the last-token recurrence (last_token.PieceBpe) gives the count at every character, with shared prefixes
computed once; a worker keeps this table for the distinct units that it meets, from task to task. The count at any prefix of a text
is that of the units before it and that of the table inside its own. So the size of a text, a budget or a truncation are read off
the table, and nothing is encoded anew.

Defined results: a null text is empty, with 0 tokens and 0 bytes; repeated rows each get their result; no rows give none; only
doc_id and text are read; a unit may be as long as a text, and takes time and memory in proportion.
"""

from __future__ import annotations

import re
from functools import lru_cache

import public_tokenizers
from pyspark.sql import DataFrame

from .bpe_codec import groups
from .last_token import PieceBpe

SPACE = PieceBpe.SPACE
UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Units, and characters of units, kept by a worker; beyond either the table starts anew.
KEPT_UNITS, KEPT_CHARS = 800_000, 12_000_000
LIMIT = 4096


class PrefixCounts:
    """Tokens of every prefix of texts. A unit is written without its space if it has just one."""

    def __init__(self, path: str, kept: int = KEPT_UNITS, kept_chars: int = KEPT_CHARS):
        import numpy as np

        self.bpe, self.kept, self.kept_chars, self.np = PieceBpe(path), kept, kept_chars, np
        self._clear()

    def _clear(self) -> None:
        np = self.np
        self.number = {"": 0}
        self.start, self.size = np.zeros(1, np.int64), np.ones(1, np.int64)  # by unit: where its table starts, and how many characters it has
        self.total = np.zeros(1, np.int64)  # by unit: its tokens
        self.table = np.zeros(1, np.int32)  # of all units: the count after each character

    def learn(self, units: list[str]):
        """The numbers of distinct units, after the tables of the new ones are made."""
        np, number = self.np, self.number
        new = [u for u in units if u not in number]
        if len(number) + len(new) > self.kept or len(self.table) > self.kept_chars:
            self._clear()
            number, new = self.number, [u for u in units if u]
        if new:
            spelt = sorted(u if u[0] == SPACE else SPACE + u for u in new)
            counts = [np.array(c, np.int32) for c in self.bpe.prefix_counts(spelt)]
            plain = [u if u[1:2] == SPACE or u == SPACE else u[1:] for u in spelt]
            number.update(zip(plain, range(len(self.start), len(self.start) + len(plain)), strict=True))
            size = np.fromiter(map(len, counts), np.int64, len(counts))
            self.start = np.concatenate([self.start, len(self.table) + np.cumsum(size) - size])
            self.size, self.total = np.concatenate([self.size, size - 1]), np.concatenate([self.total, [c[-1] for c in counts]])
            self.table = np.concatenate([self.table, *counts])
        return np.fromiter(map(number.__getitem__, units), np.int64, len(units))

    @staticmethod
    def ready(text: str) -> str:
        """The units of a text, parted by spaces. The library puts a space in front of a text that is not empty."""
        if SPACE in text or "  " in text or text[:1] == " " or text[-1:] == " ":
            return " ".join([u if u[1:2] == SPACE or u == SPACE else u[1:] for u in UNIT.findall(SPACE + text.replace(" ", SPACE))])
        return text

    def units(self, texts: list[str]):
        """(offsets, numbers): the units of all texts, and where each text's begin and end."""
        import pyarrow as pa
        import pyarrow.compute as pc

        parts = pc.split_pattern(pa.array([self.ready(t) for t in texts], pa.string()), " ")
        coded = parts.flatten().dictionary_encode()
        return parts.offsets.to_numpy(), self.learn(coded.dictionary.to_pylist())[coded.indices.to_numpy()]

    def before(self, numbers):
        """The tokens before each unit and after the last one."""
        return self.np.concatenate([[0], self.np.cumsum(self.total[numbers])])

    def at(self, text: str) -> list[int]:
        """Item i: the tokens of the first i characters, for every i."""
        _, numbers = self.units([text])
        counts = [b + c for n, b in zip(numbers.tolist(), self.before(numbers).tolist(), strict=False) for c in self.table[self.start[n] + 1 : self.start[n] + self.size[n] + 1].tolist()]
        return [0, *counts[1:]]  # without the library's own space

    def cut(self, numbers, before, limit: int) -> int:
        """The most characters that a prefix of at most so many tokens has; counts may fall inside a unit, so the last prefix that fits is taken."""
        np = self.np
        k = int(np.searchsorted(before[1:], limit, side="right"))
        length = int(self.size[numbers[:k]].sum())
        if k < len(numbers):
            n = numbers[k]
            inside = before[k] + self.table[self.start[n] : self.start[n] + self.size[n] + 1]
            length += int(np.flatnonzero(inside <= limit)[-1])
        return max(0, length - 1)  # without the library's own space


@lru_cache(maxsize=2)
def worker_counts(path: str) -> PrefixCounts:
    """One for each Python worker."""
    return PrefixCounts(path)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit, and fit_chars: the characters of the longest prefix within the limit."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        counts = worker_counts(path)
        for batch in batches:
            for ids, texts in groups(batch):
                offsets, numbers = counts.units(texts)
                total = np.diff(counts.before(numbers)[offsets])
                fit = [len(t) for t in texts]
                for i in np.flatnonzero(total > limit).tolist():
                    own = numbers[offsets[i] : offsets[i + 1]]
                    fit[i] = counts.cut(own, counts.before(own), limit)
                size = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(total), pa.array(total > limit), pa.array(fit, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
