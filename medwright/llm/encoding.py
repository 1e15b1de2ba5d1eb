"""Token ids of whole texts by the tokenizers library, with each distinct word encoded once in a while.

A text is cut where no token of the vocabularies' pre-tokenizers can reach across: behind a run of
letters that ASCII punctuation, a digit or white space follows, and between any other character and white
space. A word is such a piece with the white space before it. The ids of a text are the ids of its words
in a row, so the library encodes words it has not met lately and the rest comes from a bounded memory.
Texts that hold the name of a special token are encoded whole.
"""

from __future__ import annotations

import gc
import re
from array import array
from collections.abc import Sequence
from functools import lru_cache

import numpy as np

from medwright.llm.common import KEPT, unburden

#: Words of the newer and of the older half of the memory: some 170 MB a worker, which keeps it from task to task until it goes on to other work.
REMEMBERED = 400_000

# White space is that of Unicode, without \x1c-\x1f, which only Python counts. The letters named here are
# letters to every pre-tokenizer, in either case (\u0130 is left out: in lower case it ends with a mark,
# which is no letter); others only mean fewer cuts.
# The first choice finds what the second would, sooner: most words stand behind one space.
_WORDS = re.compile(r" [A-Za-zÀ-ÖØ-öø-įı-ɏ]+(?=[ .,\n:;!?\"'()-])|"
                    r"[^\S\x1c-\x1f]*(?:[A-Za-zÀ-ÖØ-öø-įı-ɏ]+(?=[^\S\x1c-\x1f]|[!-/:-@\[-`{-~0-9]|\Z)|[\S\x1c-\x1f]+)|[^\S\x1c-\x1f]+")


#: A space and Latin-1 letters: such a word is one unit of the pre-tokenizer and goes straight to the library's model.
_PLAIN = re.compile(r" [A-Za-zÀ-ÖØ-öø-ÿ]+\Z")
_SAMPLE = [" a", " the", " Reading", " OVER", " naïve", " Éclair", " straße", " ÑANDÚ", " zzyzxq", " øre", " þing"]


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a byte as the character of its number if that prints, else as one from 256 up."""
    silent = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
    return {b: chr(256 + i) for i, b in enumerate(silent)}


class _Memory(dict):
    """Words and their ids; a word that is not there is learnt when it is looked up, so texts are gone over once."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self.learn(word)
        return ids


class Encoder:
    """Ids of texts as little-endian uint32 bytes."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.remembered = remembered
        self.words = _Memory(self._learn)
        self.older: dict[str, bytes] = {}
        self.letters = _byte_letters()
        # How the model wants a plain word, by trial: with the space (byte-level), or bare and in lower case.
        whole = [x.tolist() for x in self._ids(_SAMPLE)]
        self.plain = next((f for f in (self._spaced, self._bare) if [[t.id for t in self.model.tokenize(f(w))] for w in _SAMPLE] == whole), None)

    def _spaced(self, word: str) -> str:
        return self.letters[32] + word[1:] if word.isascii() else word.encode().decode("latin-1").translate(self.letters)

    def _bare(self, word: str) -> str:
        word = word[1:].lower()
        return word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)

    def _ids(self, texts: Sequence[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)]

    def _learn(self, word: str) -> bytes:
        """The ids of a word: as remembered longer ago, or by the library."""
        ids = self.older.get(word)
        if ids is None:
            if self.plain and _PLAIN.match(word):
                ids = array("I", [t.id for t in self.model.tokenize(self.plain(word))]).tobytes()
            else:
                ids = self._ids([word])[0].tobytes()
        return ids

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """The ids of each text; null has none."""
        out = []
        for text in texts:
            if len(self.words) > self.remembered:
                self.older, self.words = self.words, _Memory(self._learn)
            if not text:
                out.append(b"")
            elif any(s in text for s in self.specials):
                out.append(self._ids([text])[0].tobytes())
            else:
                out.append(b"".join(map(self.words.__getitem__, _WORDS.findall(text))))
        return out


@lru_cache(maxsize=2)
def encoder(path: str, remembered: int = REMEMBERED) -> Encoder:
    """One encoder for a worker process and vocabulary: tasks that follow each other share its memory.

    What the worker has left from other work goes first, so that the two don't add up.
    """
    unburden()
    return Encoder(path, remembered)


def _forget() -> None:
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        gc.collect()  # an encoder and its memory refer to each other


KEPT.append(_forget)
