"""Token ids of the public word-end BPE vocabulary, at corpus speed.

The tokenizer lower-cases, drops white space and never lets a token cross it, so a text's ids are those of its
white-space words one after another. Words repeat, so each distinct word goes through the tokenizers library once per
Python worker and is remembered. Texts with characters for which Python's and the library's rules may differ (anything
from U+0250 on, and control white space) or that hold an added token's literal take the library's own path, whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Words in each of a worker's two generations of memory: a full young one becomes the old one; and the longest word that is
#: remembered. Together they bound its memory, never the results.
REMEMBERED, REMEMBERED_CHARS = 500_000, 48
#: Characters of the texts that are encoded at once.
RUN_CHARS = 12_000_000
#: ASCII characters that are neither letters nor digits nor white space.
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_UNLIKE = re.compile("[\x1c-\x1f\x85\xa0ɐ-\U0010ffff]")
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, others for the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def plain(text: str) -> bool:
    """Whether Python's rules for the text's characters are the library's."""
    if text.isascii():
        return not ("\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text)
    return not _UNLIKE.search(text)


class WordEncoder(dict):
    """``ids(text)``: the ids as uint32, equal to ``encode(text, add_special_tokens=False)``. As a dict: word to id bytes."""

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        #: Added tokens all hold this sign, which is looked for first.
        self.tame = all("<|" in x for x in self.added)
        self.model = self.library.model
        self.alphabet = _byte_letters()
        self.old: dict[str, bytes] = {}

    def plain(self, text: str) -> bool:
        """Whether the text's ids are those of its words. An added token's literal, in any case, may be one id, and isn't bound to a word."""
        if not plain(text):
            return False
        return "<|" not in text and self.tame or not any(x in text or x.lower() in text.lower() for x in self.added)

    def __missing__(self, word: str) -> bytes:
        known = self.old.get(word)
        if known is None:
            known = b"".join(map(self._piece, (word,) if word.isalpha() else _PIECES.findall(word)))
        if len(word) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[word] = known
        return known

    def _piece(self, piece: str) -> bytes:
        letters = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, dtype="<u4")
        if not self.plain(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.frombuffer(b"".join(map(self.__getitem__, text.lower().split())), dtype="<u4")


    def batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """``ids`` of each text. Words are told apart by Arrow's dictionary encoding, a bounded run of texts at a time."""
        out: list[np.ndarray] = []
        run: list[str] = []
        held = 0
        for text in texts:
            if text and not self.plain(text):
                out += self._run(run)
                out.append(self.ids(text))
                run, held = [], 0
                continue
            run.append(text.lower() if text else "")
            held += len(run[-1])
            if held > RUN_CHARS:
                out += self._run(run)
                run, held = [], 0
        return out + self._run(run)

    def _run(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of lower-cased texts without unlike characters, as parts of one array."""
        if not texts:
            return []
        words = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary
        # letters, then signs: the two never join, and each is known by itself
        stems = pc.utf8_rtrim(distinct, SIGNS)
        cut = pc.and_(pc.utf8_is_alpha(stems), pc.not_equal(stems, distinct))
        signs = pc.replace_substring_regex(pc.if_else(cut, distinct, ""), r"^\pL+", "")
        flat, begins, sizes = self._table(pc.if_else(cut, stems, distinct), signs)
        flat, ends = spliced(flat, begins, sizes)
        sizes = sizes.reshape(2, -1, order="F").sum(axis=0)
        word = coded.indices.to_numpy()
        ids, ends = spliced(flat, (np.cumsum(sizes) - sizes)[word], sizes[word])
        upto = np.concatenate(([0], ends))[words.offsets.to_numpy()]
        return [ids[a:b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]

    def _table(self, heads: pa.Array, tails: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the distinct parts one after another; where those of head, tail, head, tail ... begin, and how many there are."""
        coded = [x.dictionary_encode() for x in (heads, tails)]
        known = [ids for c in coded for ids in map(self.__getitem__, c.dictionary.to_numpy(zero_copy_only=False))]
        size = np.fromiter(map(len, known), np.int64, len(known)) >> 2
        part = np.stack((coded[0].indices.to_numpy(), coded[1].indices.to_numpy() + len(coded[0].dictionary)), axis=1).ravel()
        return np.frombuffer(b"".join(known), dtype="<u4"), (np.cumsum(size) - size)[part], size[part]


def spliced(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``flat`` that begin at ``begins``, one after another; and where each ends in the result."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(begins - (ends - sizes), sizes) + np.arange(len(ends) and ends[-1])], ends


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for ``path``; it stays between tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
