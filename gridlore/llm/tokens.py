"""Byte-level BPE ids of whole texts, with the tokenizers library asked once for each distinct word.

The pre-tokenizer of the file always ends a piece before a single blank, and around a single line feed, between two characters that are
not white space, and between letters and the marks after them, whatever stands around. Texts are cut there, and ids of the cuts are kept: the ids of a text
are those of its cuts in order, equal to what the library gives for the whole text (the tests compare). Strings of special tokens
in a text are ordinary text.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

import numpy as np

_SPACES = re.compile(r"\s\s")
#: Before a blank between characters that aren't white space.
_CUT = re.compile(r"(?<=\S)(?= \S)")
_LF = "\n"
_MARKS = ".,;:!?%&*#$|()"
#: Words encoded in one call, and words of a text looked up at a time.
JOINED, WORDS_AT_ONCE = 2000, 1 << 18


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Letters before this one are letters in every version of the tables.
_LETTERS_TO = "\u0250"


def _single(text: str) -> bool:
    """No white space side by side or at an end."""
    flat = text.replace(_LF, " ")
    if flat.isprintable():  # no white space but blanks
        return not ("  " in flat or flat[0] == " " or flat[-1] == " ")
    return not (_SPACES.search(text) or text[0].isspace() or text[-1].isspace())


class _Bytes(dict):
    """Character -> the library's characters for its bytes, for str.translate."""

    def __missing__(self, c: int) -> str:
        from tokenizers.pre_tokenizers import ByteLevel

        self[c] = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(c))[0][0]
        return self[c]


class WordIds:
    """Ids as little-endian unsigned 32-bit bytes, by word. A word stands for itself after a blank; with a line feed before it, for the line feed and itself.

    Two generations of at most ``most`` words each bound the memory, and frequent words stay.
    """

    def __init__(self, path: str, most: int = 450_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.most, self.new, self.old, self.other = most, {}, {}, {}
        self.lf = self.raw(_LF)
        self.lf_id = int(np.frombuffer(self.lf, "<u4")[0])
        # what the cuts rest on, asked of this file: else whole texts are encoded
        same = lambda *cuts: self.raw("".join(cuts)) == b"".join(map(self.raw, cuts))
        self.cuts = len(self.lf) == 4 and all(same(*x) for x in (("a", _LF, " b"), ("a", _LF, "b"), ("a", " b"), ("a.", " ,b"), (" ab", "."), (" ab", "%%%"), ("é", " 1")))

        self.table = _Bytes()
        self.direct = array("I").itemsize == 4 and sys.byteorder == "little" and len(self.table[32]) == 1 and all(self.raw(" " + w) == self.letters(" " + w) for w in ("a", "abc", "Überzeugung", "élèvent", "internationalisation"))

    def letters(self, text: str) -> bytes:
        """Ids of letters with at most a blank before them, which the pre-tokenizer leaves whole: the model alone."""
        return array("I", [t.id for t in self.tokenizer.model.tokenize(text.translate(self.table))]).tobytes()

    def raw(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def joined(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without line feeds, none ending with white space, in one call: the ids of the line feeds between them show where each ends."""
        ids = np.array(self.tokenizer.encode_batch_fast([_LF.join(texts)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(ids == self.lf_id)
        if len(ends) != len(texts) - 1:
            return [self.raw(t) for t in texts]
        raw, at = ids.tobytes(), [0, *(4 * ends + 4).tolist(), 4 * len(ids) + 4]
        return [raw[a : b - 4] for a, b in zip(at, at[1:])]

    def learn(self, words: set[str]) -> None:
        if len(self.new) + len(words) > self.most:
            self.old, self.new = self.new, {}
        old, new = self.old, self.new
        if old:
            again = [w for w in words if w in old]
            new.update([(w, old[w]) for w in again])
            words.difference_update(again)
        whole, marked, lf = [], [], self.lf
        blank, model, table, direct = self.table[32], self.tokenizer.model.tokenize, self.table, self.direct

        def one(w: str) -> None:
            """Letters at once, others later in one call."""
            plain = w.isascii()
            if direct and w.isalpha() and (plain or max(w) < _LETTERS_TO):
                new[w] = array("I", [t.id for t in model(blank + (w if plain else w.translate(table)))]).tobytes()
            elif direct and w[0] == _LF and w[1:].isalpha() and max(w) < _LETTERS_TO:
                new[w] = lf + array("I", [t.id for t in model(w[1:].translate(table))]).tobytes()
            else:
                whole.append(w)

        for w in words:
            base = w.rstrip(_MARKS)
            letters = base[1:] if base[:1] == _LF else base
            if base != w and letters.isalpha() and (letters.isascii() or max(letters) < _LETTERS_TO):
                marked.append((w, base))
            else:
                one(w)
        for base in {b for _, b in marked}:
            if base not in new:
                one(base)
        for at in range(0, len(whole), JOINED):
            part = whole[at : at + JOINED]
            new.update([(w, lf + i if w[0] == _LF else i) for w, i in zip(part, self.joined([w[1:] if w[0] == _LF else " " + w for w in part]))])
        for w, base in marked:
            new[w] = new[base] + self.mark(w[len(base) :])

    def mark(self, marks: str) -> bytes:
        if marks not in self.other:
            self.other[marks] = self.raw(marks)
        return self.other[marks]

    def ids(self, words: list[str]) -> bytes:
        out = []
        for at in range(0, len(words), WORDS_AT_ONCE):
            part = words[at : at + WORDS_AT_ONCE]
            found = list(map(self.new.get, part))
            try:
                out.append(b"".join(found))
            except TypeError:  # None: words not met before; what was found stays valid if the generations change
                missing = [k for k, i in enumerate(found) if i is None]
                self.learn({part[k] for k in missing})
                for k in missing:
                    found[k] = self.new[part[k]]
                out.append(b"".join(found))
        return b"".join(out)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.cuts:
            return self.raw(text)
        if _single(text):
            return self.ids((_LF + text).replace(_LF, " \n")[1:].split(" "))[4:]
        # white space side by side: cuts with any of it are encoded by themselves
        if len(self.other) > 20_000:
            self.other.clear()
        out = []
        for piece in _CUT.split(text):
            if piece[0] == " " and len(piece) > 1 and not any(map(str.isspace, piece[1:])):
                out.append(self.ids([piece[1:]]))
            elif len(piece) > 1000:
                out.append(self.raw(piece))
            else:
                out.append(self.mark(piece))
        return b"".join(out)


_KNOWN: dict[str, WordIds] = {}


def encode(texts: list[str | None], path: str) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit bytes; null: none. One cache per worker process."""
    if path not in _KNOWN:
        _KNOWN[path] = WordIds(path)
    return list(map(_KNOWN[path], texts))
