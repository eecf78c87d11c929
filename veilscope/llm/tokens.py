"""Token ids of whole texts, from the vocabulary files of the public tokenizers.

Words recur far more often than texts do, so a worker keeps the ids of the chunks it has met. Chunks are cut only
where the pre-tokenizer of the vocabulary cuts as well, hence the ids equal those of the whole text (the tests
compare them). A chunk that is one plain word goes straight to the model of the tokenizer; anything else takes the
whole way through normalizer and pre-tokenizer. A text in which a cut would not be safe is encoded in one piece.
"""

from __future__ import annotations

from array import array
from functools import lru_cache

import numpy as np

#: A worker keeps so many chunks at most, and none longer than CACHE_CHARS.
CACHE_CHUNKS = 600_000
CACHE_CHARS = 40
_MARK = "\x00"


def vocabulary(name: str) -> str:
    """The place of a vocabulary file of the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class _Known(dict):
    """Ids by chunk; a chunk that is missing is encoded, and kept while there is room."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.refused = encode, 0

    def __missing__(self, chunk: str) -> bytes:
        ids = self.encode(chunk)
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= CACHE_CHUNKS:
                self.refused += 1
                if self.refused > 4 * CACHE_CHUNKS:  # other texts than those that filled it
                    self.clear()
                    self.refused = 0
                return ids
            self[chunk] = ids
        return ids


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    ``byte_level``: blanks belong to the word after them; else the vocabulary lowers letters and drops white space."""

    def __init__(self, path: str, byte_level: bool):
        from tokenizers import Tokenizer

        self.tokenizer, self.byte_level = Tokenizer.from_file(path), byte_level
        self.tokenize = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.known = _Known(self._chunk)
        self.ends = {x: self._whole([x])[0] for x in ".,"}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes | None:
        """Ids of one plain word of Latin-1 letters, with its blank if the vocabulary is byte-level."""
        blank = self.byte_level and word[:1] == " "
        bare = word[1:] if blank else word
        if not bare.isalpha():
            return None
        if not self.byte_level:
            bare = bare.lower()
        if not bare.isascii():
            if max(bare) > "\xff":
                return None
            letters = self.letters
            bare = "".join([letters[b] for b in bare.encode()])
        return array("I", [t.id for t in self.tokenize(self.letters[32] + bare if blank else bare)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        end = self.ends.get(chunk[-1:])
        if end is not None:  # a letter and one mark at the end are two pre-tokens
            ids = self.known.get(chunk[:-1]) if chunk[-2:-1].isalpha() else None
            ids = self._word(chunk[:-1]) if ids is None else ids
            if ids is not None:
                return ids + end
        ids = self._word(chunk)
        return self._whole([chunk])[0] if ids is None else ids

    def chunks(self, text: str) -> list[str] | None:
        """Pieces that can be encoded one by one: cut at single blanks and line feeds between other characters.

        None if there is any other white space or control character, or what may be a special token."""
        flat = text.replace("\n", " ")
        if not flat.isprintable() or "  " in flat or flat[:1] in (" ", "") or flat[-1] == " " or "<|" in flat:
            return None
        if self.byte_level:
            return text.replace(" ", f"{_MARK} ").replace("\n", f"{_MARK}\n{_MARK}").split(_MARK)
        return flat.split(" ")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null counts as empty."""
        look, out = self.known.__getitem__, []
        for text in texts:
            cut = self.chunks(text or "")
            out.append(self._whole([text or ""])[0] if cut is None else b"".join(map(look, cut)))
        return out


@lru_cache(4)
def encoder(path: str, byte_level: bool) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path, byte_level)
