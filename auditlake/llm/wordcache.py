"""Token ids of whole texts, word by word.

The vocabulary file's rules never join anything across ASCII white space, so a
text's ids are those of its words in order; words are looked up in a bounded
table.  For vocabularies of that kind (lower-cased BPE with word ends) plain
Latin words go straight to the BPE model, all others through the library's whole
chain.  A test compares both with the library on whole texts.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import regex

#: Words kept in a task's table; a full table is started afresh.
TABLE = 400_000
#: The file's own pattern (a fixed value), for words of Latin letters.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: No combining marks, no capital that lowers to more than one character.
SIMPLE = regex.compile(r"[!-~¡-įı-ž]+")


def byte_letters() -> list[str]:
    """The usual letters for bytes: printable ones stand for themselves, the others are numbered from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class WordTokenizer:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = dict(enumerate(byte_letters()))
        self.marks = sorted(str(t) for t in (x.content for x in self.whole.get_added_tokens_decoder().values()))
        self.table: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def piece(self, text: str) -> bytes:
        if (got := self.pieces.get(text)) is None:
            mapped = text if text.isascii() else text.encode().decode("latin-1").translate(self.letters)
            got = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
            if len(self.pieces) >= TABLE:
                self.pieces.clear()
            self.pieces[text] = got
        return got

    def word(self, raw: bytes) -> bytes:
        text = raw.decode("utf-8", "replace")
        core = text.rstrip(MARKS)
        # letters, then punctuation: two pieces, without asking the pattern
        if core.isalpha() and max(core) <= "\u017e" and "\u0130" not in core and len(text) < 200:
            return self.piece(core.lower()) + self.piece(text[len(core) :]) if len(core) < len(text) else self.piece(core.lower())
        if len(text) < 200 and SIMPLE.fullmatch(text) and not any(m in text for m in self.marks):
            return b"".join([self.piece(p) for p in PIECE.findall(text.lower())])
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
        raw, table = data.tobytes(), self.table
        for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            found = raw[a:z].split()
            try:
                yield b"".join([table[w] for w in found])
                continue
            except KeyError:
                pass
            if len(table) >= TABLE:
                table.clear()
            for w in found:
                if w not in table:
                    table[w] = self.word(w)
            yield b"".join([table[w] for w in found])
