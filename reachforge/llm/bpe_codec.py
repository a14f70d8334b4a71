"""BPE encoding and decoding by prefix-sharing trie traversal.

Texts are cut into words by built-in Arrow functions, half a million characters at a time, and the distinct words are numbered. New
words are walked in trie order with their last-token states (last_token.WordBpe), so shared prefixes are computed once; a bounded
table of each Python worker, which lasts from task to task, keeps their ids. Texts are decoded from their ids alone. Special strings
in a text, as the vocabulary lists them, become their own ids, as the library does by default. Nothing is shuffled.

Defined results: a null text is an empty one and has no tokens; repeated rows each get their result; a table without rows gives
none; only doc_id and text are read, so extra columns never clash; a word may be as long as a text, and takes time and memory in
proportion.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from hashlib import sha256

import public_tokenizers
from pyspark.sql import DataFrame

from .common import parts
from .last_token import WordBpe

#: Words, and characters of words, kept by a worker; beyond either the table starts anew.
KEPT_WORDS, KEPT_CHARS = 150_000, 3_000_000
#: Texts are taken in groups of about so many characters.
GROUP_CHARS = 500_000

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

#: Private characters that stand for special strings, and in front of words that the library's own splitter gave.
SPECIAL, GIVEN = 0xE000, ""
#: The vocabulary's own word pattern, for lower-case texts of Latin letters and with the private characters.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|\pL+|\pN|[\x{E000}-\x{EFFF}]|[^ \t-\r\pL\pN\x{E000}-\x{EFFF}]+"
#: Characters beyond those that the pattern here and the library's are known to see alike.
BEYOND = re.compile("[^\x00-ɏ]")
#: White space of the pattern that is not ASCII.
WIDE_SPACE = "\x85\xa0"


class Codec:
    def __init__(self, path: str, kept: int = KEPT_WORDS, kept_chars: int = KEPT_CHARS):
        import numpy as np
        import pyarrow as pa

        self.bpe, self.kept, self.kept_chars = WordBpe(path), kept, kept_chars
        self.special = list(self.bpe.special.items())
        texts = {i: t for t, i in self.bpe.vocab.items()} | {i: t for t, i in self.special}
        size = max(texts) + 1
        self.text_of = pa.array([texts.get(i, "") for i in range(size)])
        self.digits_of = pa.array(list(map(str, range(size))))
        self.np, self.pa = np, pa
        self._clear()

    def _clear(self) -> None:
        np = self.np
        self.number, self.chars = {"": 0}, 0  # of each known word
        self.start, self.size = np.zeros(1, np.int64), np.zeros(1, np.int64)  # by number: its place in ids, and how many
        self.ids = np.zeros(0, np.int32)

    def learn(self, words: list[str]):
        """The numbers of distinct words, after the new ones of them are encoded."""
        np, number = self.np, self.number
        new = [w for w in words if w not in number]
        if len(number) + len(new) > self.kept or self.chars > self.kept_chars:
            self._clear()
            number, new = self.number, [w for w in words if w]
        if new:
            symbols = [self._symbols(w) for w in new]
            flat = sorted({s for s in symbols if s.__class__ is str})
            tokens = dict(zip(flat, self.bpe.encode_sorted(flat), strict=True))
            vocab = self.bpe.vocab
            found = [[vocab[t] for t in tokens[s]] if s.__class__ is str else [s] for s in symbols]
            size = np.fromiter(map(len, found), np.int64, len(found))
            first = len(self.ids) + np.cumsum(size) - size
            number.update(zip(new, range(len(self.start), len(self.start) + len(new)), strict=True))
            self.chars += sum(map(len, new))
            self.start, self.size = np.concatenate([self.start, first]), np.concatenate([self.size, size])
            self.ids = np.concatenate([self.ids, np.fromiter((i for f in found for i in f), np.int32, int(size.sum()))])
        return np.fromiter(map(number.__getitem__, words), np.int64, len(words))

    def _symbols(self, word: str) -> str | int:
        """A word in the byte alphabet, or the id that it stands for."""
        if word[0] == GIVEN:
            return word[1:]
        if SPECIAL <= ord(word[0]) < ord(GIVEN):
            return self.special[ord(word[0]) - SPECIAL][1]
        return word if word.isascii() and word.isprintable() else self.bpe.bytes_of(word)  # the alphabet leaves ! to ~ as they are

    def _ready(self, text: str) -> tuple[bool, str]:
        """(whether the pattern is still to be applied, the text with special strings as private characters)."""
        if text.isascii() or not BEYOND.search(text):
            for k, (mark, _) in enumerate(self.special):
                if mark in text:
                    text = text.replace(mark, chr(SPECIAL + k))
            if text.isascii():
                return True, text.lower()
            text = unicodedata.normalize("NFC", text).lower()
            for space in WIDE_SPACE:
                text = text.replace(space, " ")
            return True, text
        return False, " ".join(self._given(text))

    def _given(self, text: str):
        """Words by the library's own normaliser and splitter; of ASCII white space they hold none, so it parts a text beforehand."""
        marks = {m: k for k, (m, _) in enumerate(self.special)}
        parts = re.split("(" + "|".join(map(re.escape, marks)) + ")", text) if any(m in text for m in marks) else [text]
        for part in parts:
            if part in marks:
                yield chr(SPECIAL + marks[part])
            else:
                for w, _ in self.bpe.lib.pre_tokenizer.pre_tokenize_str(self.bpe.lib.normalizer.normalize_str(part)):
                    yield GIVEN + w

    def encode(self, texts: list[str]):
        """(offsets, ids): the ids of all texts, and where each text's begin and end."""
        import pyarrow.compute as pc

        np, pa = self.np, self.pa
        ready = [self._ready(t) for t in texts]
        array = pa.array([t for _, t in ready], pa.string())
        raw = np.array([r for r, _ in ready], bool)
        if raw.all():
            array = pc.replace_substring_regex(array, WORD, r"\0 ")
        elif raw.any():
            parted = pc.replace_substring_regex(array.filter(pa.array(raw)), WORD, r"\0 ")
            place = np.where(raw, np.cumsum(raw) - 1, int(raw.sum()) + np.cumsum(~raw) - 1)
            array = pa.concat_arrays([parted, array.filter(pa.array(~raw))]).take(pa.array(place))
        words = pc.ascii_split_whitespace(array)
        coded = words.flatten().dictionary_encode()
        number = self.learn(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        size = self.size[number]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
        ids = self.ids[np.arange(ends[-1]) + np.repeat(self.start[number] - ends[:-1], size)]
        return ends[words.offsets.to_numpy()], ids

    def joined(self, offsets, values) -> list[bytes]:
        """Of each text: its values, joined by spaces, in UTF-8."""
        import pyarrow.compute as pc

        lists = self.pa.ListArray.from_arrays(self.pa.array(offsets.astype(self.np.int32)), values)
        return pc.binary_join(lists, " ").cast(self.pa.binary()).to_pylist()

    def digits(self, offsets, ids) -> list[bytes]:
        """Of each text: its decimal ids."""
        return self.joined(offsets, self.digits_of.take(self.pa.array(ids)))

    def decode(self, offsets, ids) -> list[bytes]:
        """Of each text: what the ids stand for, joined by spaces, as the library does without a decoder."""
        return self.joined(offsets, self.text_of.take(self.pa.array(ids)))


@lru_cache(maxsize=2)
def worker_codec(path: str) -> Codec:
    """One for each Python worker, so that words learnt in one task serve the next."""
    return Codec(path)


def groups(batch, most: int | None = None):
    """The rows of an Arrow batch of (doc_id, text) as lists, some texts at a time; only these are Python strings. Null texts are empty."""
    for part in parts(batch, 1, most or GROUP_CHARS):
        yield part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]


def encode_documents(docs: DataFrame, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256; with keep_ids the ids themselves too."""
    path = path or public_tokenizers.path("word_bpe_49k.json")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        codec = worker_codec(path)
        digest = lambda values: pa.array([sha256(v).hexdigest() for v in values])
        for batch in batches:
            for doc_ids, texts in groups(batch):
                offsets, ids = codec.encode(texts)
                cols = [pa.array(doc_ids, pa.int64()), pa.array(np.diff(offsets)), digest(codec.digits(offsets, ids)), digest(codec.decode(offsets, ids))]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)
        pa.default_memory_pool().release_unused()  # the worker stays when its task ends

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA + (", ids array<int>" if keep_ids else ""))
