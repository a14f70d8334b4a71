"""Byte-pair encodings by dynamic programming over last tokens.

The tokens of a prefix are fixed by its last token: they are the tokens of what is left before it, and then it. A token fits
after another exactly when encoding the two of them alone gives back the two. So last[i], the last token of the first i symbols,
is the one vocabulary entry that ends at i and fits after last[start]; no prefix is ever encoded anew.
"""

from __future__ import annotations

import json

#: Pairs of tokens whose fit a worker keeps, some 250 bytes each; beyond that the table starts anew.
SEEN_PAIRS = 200_000


def byte_alphabet() -> list[str]:
    """The printable character of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the others follow from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class Merges:
    """Token fits of a vocabulary given by ranks: joined(a, b) is the rank of the merge of two token texts, or None."""

    def __init__(self, split: dict, rank: dict):
        self.split, self.rank, self.seen = split, rank, {}

    def fits(self, a: str, b: str) -> bool:
        key = (a, b)
        found = self.seen.get(key)
        if found is None:
            if len(self.seen) >= SEEN_PAIRS:
                self.seen.clear()
            found = self.seen[key] = self._fits(a, b)
        return found

    def _fits(self, a: str, b: str) -> bool:
        """Takes the two tokens apart in the reverse order of their merges. At each step a merge across the border that comes before the last undone merges would have happened."""
        rank, split = self.rank, self.split
        limit = 1 << 60
        while True:
            r = rank.get((a, b))
            if r is not None and r < limit:
                return False
            sa, sb = split.get(a), split.get(b)
            if sa is None and sb is None:
                return True
            ra, rb = (rank[sa] if sa else -1), (rank[sb] if sb else -1)
            if ra > rb:  # the left token was made last
                limit, a = ra, sa[1]
            else:  # a merge of the same rank across the border stands to the left, so it comes first
                limit, b = rb + 1, sb[0]


class WordBpe:
    """Encoder for a vocabulary with word ends; words come as sorted lists and share the work of their prefixes."""

    END = "</w>"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        rank = {m: i for i, m in enumerate(merges)}
        self.fit = Merges({a + b: (a, b) for a, b in reversed(merges)}, rank)
        self.lib = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ends = {t[i:] for t in self.vocab for i in range(len(t))}
        self.alphabet = byte_alphabet()

    def bytes_of(self, word: str) -> str:
        """A word in the byte alphabet."""
        return "".join(map(self.alphabet.__getitem__, word.encode()))

    def encode_sorted(self, words: list[str]) -> list[list[str]]:
        """Tokens of sorted distinct words. Sorted order is the depth-first order of their trie: a word starts from the states of the prefix that it shares with the one before."""
        vocab, fits, seen, ends, end = self.vocab, self.fit.fits, self.fit.seen, self.ends, self.END
        last: list[str] = [""]  # last[i]: the last token of the word's first i symbols
        out, before = [], ""
        for w in words:
            n = len(w)
            k, most = 0, min(n - 1, len(before) - 1)
            while k < most and w[k] == before[k]:
                k += 1
            del last[k + 1 :]
            for i in range(k + 1, n + 1):
                for j in range(i - 1, -1, -1):  # from the shortest; just one fits
                    t = w[j:i] if i < n else w[j:] + end
                    if t in vocab:
                        if j == 0:
                            break
                        ok = seen.get((last[j], t))
                        if ok if ok is not None else fits(last[j], t):
                            break
                    elif t not in ends:
                        raise ValueError(f"no token ends {t!r}")
                if i < n:
                    last.append(t)
            tokens, i = [t], n - (len(t) - len(end))
            while i > 0:
                tokens.append(last[i])
                i -= len(last[i])
            out.append(tokens[::-1])
            before = w
        return out


class PieceBpe:
    """Prefix counts for a vocabulary of scored pieces with byte fallback."""

    SPACE = "▁"

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in normal}
        self.lib = sp
        self.ends = {p[i:] for p in self.score for i in range(len(p))}
        self.seen: dict = {}

    def merge(self, symbols: list[str]) -> list[str]:
        """Plain merging, best score first and leftmost among equals; only for the few symbols of two tokens."""
        score, symbols = self.score, list(symbols)
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def fits(self, a: str, b: str) -> bool:
        key = (a, b)
        found = self.seen.get(key)
        if found is None:
            if len(self.seen) > 1_000_000:
                self.seen.clear()
            found = self.seen[key] = self.merge(list(a + b)) == [a, b]
        return found

    def own(self, t: str) -> bool:
        """Whether a piece is what its own symbols merge to."""
        found = self.seen.get(t)
        if found is None:
            found = self.seen[t] = self.merge(list(t)) == [t]
        return found

    def prefix_counts(self, units: list[str]):
        """Of sorted distinct units, one after the other: item i is the tokens of the first i characters. A unit starts from the states of the prefix that it shares with the one before. Characters outside the vocabulary count as their UTF-8 bytes."""
        score, ends, fits, seen = self.score, self.ends, self.fits, self.seen
        last, count, before = [""], [0], ""
        for unit in units:
            k, most = 0, min(len(unit), len(before))
            while k < most and unit[k] == before[k]:
                k += 1
            del last[k + 1 :], count[k + 1 :]
            for i in range(k + 1, len(unit) + 1):
                for j in range(i - 1, -1, -1):  # from the shortest; just one fits
                    t = unit[j:i]
                    if t in score:
                        ok = seen.get((last[j], t)) if j else self.own(t)
                        if ok if ok is not None else fits(last[j], t):
                            last.append(t)
                            count.append(count[j] + 1)
                            break
                    elif t not in ends:
                        break
                if len(last) == i:  # bytes
                    c = unit[i - 1]
                    last.append(c)
                    count.append(count[i - 1] + len(c.encode("utf-8", "replace")))
            before = unit
            yield count
