"""Exact, fast use of a tokenizers file: texts are cut where the file's own rules
always cut, and each distinct piece is encoded by the library once a worker.

Two kinds of file are known: byte-level ones whose pieces carry a leading space, and
word ones that lower-case and drop white space. A text made of Latin letters, ASCII
and common punctuation is cut by a pattern equal to the file's on such characters;
any other text is cut at white space only, which both kinds never cross. Pieces are
independent of one another in either kind, so joining their ids gives the library's
ids for the whole text. Strings of special tokens count as ordinary text.
"""

from __future__ import annotations

import gc
import json
import os
import re
import struct
from itertools import accumulate, chain

#: Characters that Unicode calls white space.
WS = "\t-\r \x85\xa0  -     　"
#: Letters whose case, composition and class are the same in every Unicode version.
LETTERS = "A-Za-zÀ-ÖØ-öø-įĹ-ňŊ-ž"
_PLAIN = re.compile(f"[\t\n\r -~{LETTERS}¡£§«»¿–—‘-”…€]*")
# the commonest alternatives first; endings begin with an apostrophe, which only the
# last alternatives could take instead
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
_BYTE_PLAIN = re.compile(f" ?[{LETTERS}]+| ?[0-9]+|{_ENDINGS}| ?[^{WS}{LETTERS}0-9]+|[{WS}]+(?![^{WS}])|[{WS}]+")
_WORD_PLAIN = re.compile(f"[{LETTERS}]+|[0-9]|{_ENDINGS}|[^{WS}{LETTERS}0-9]+")
#: A space between white space, and what str.split takes for white space besides WS.
_BOTH_SIDES = re.compile("[\t-\r\x1c-\x1f\x85\xa0] [\t-\r\x1c-\x1f\x85\xa0]")
_SEPARATORS = re.compile("[\x1c-\x1f]")
_BYTE_ANY = re.compile(f"[{WS}]*[^{WS}]+|[{WS}]+")
_WORD_ANY = re.compile(f"[^{WS}]+")

#: Longer pieces and chunks are encoded each time and not kept.
KEEP_CHARS = 48
#: Entries kept in a worker: so many of late use, and as many from before them.
KEEP_PIECES = 350_000
KEEP_CHUNKS = 500_000
KEEP_OTHERS = 100_000
_encoders: dict[str, "PieceEncoder"] = {}


class Kept:
    """Ids by string, in two generations: when the later one is full it replaces the
    earlier one, from which what is still used moves up."""

    def __init__(self, most: int):
        self.most, self.now, self.before = most, {}, {}

    def ids(self, strings: list[str], make) -> list[bytes]:
        """Ids of each string; ``make(list)`` gives those of new ones."""
        if len(self.now) > self.most:
            self.before, self.now = self.now, {}
        out = list(map(self.now.get, strings))
        missing = [i for i, x in enumerate(out) if x is None]
        if missing:
            found = dict.fromkeys(strings[i] for i in missing)
            new = []
            for p in found:
                ids = found[p] = self.before.get(p)
                if ids is None:
                    new.append(p)
            found.update(zip(new, make(new) if new else ()))
            for i in missing:
                out[i] = found[strings[i]]
            self.now.update((p, x) for p, x in found.items() if len(p) <= KEEP_CHARS)
        return out


def byte_letters() -> dict[int, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable bytes for
    themselves, the others, in order, for the letters from 256 on."""
    shown = [b for b in range(256) if chr(b).isprintable() and chr(b) != " "]
    hidden = [b for b in range(256) if b not in shown]
    return {**{b: b for b in shown}, **{b: 256 + i for i, b in enumerate(hidden)}}


class PieceEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.words = "</w>" == rules["model"].get("end_of_word_suffix")
        self.plain, self.any = (_WORD_PLAIN, _WORD_ANY) if self.words else (_BYTE_PLAIN, _BYTE_ANY)
        self.dtype = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        self.letters = byte_letters()
        self.kept, self.others, self.chunks = Kept(KEEP_PIECES), Kept(KEEP_OTHERS), Kept(KEEP_CHUNKS)

    def _pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.dtype == '<u2' else 'I'}", *ids)

    def _of_pieces(self, pieces: list[str]) -> list[bytes]:
        """The file's pieces go straight to the library's model."""
        tokenize, letters, pack = self.library.model.tokenize, self.letters, self._pack
        return [pack([t.id for t in tokenize(p.encode().decode("latin-1").translate(letters))]) for p in pieces]

    def _of_others(self, stretches: list[str]) -> list[bytes]:
        """Stretches of any text, which the library cuts itself."""
        found = self.library.encode_batch_fast(stretches, add_special_tokens=False)
        return [self._pack(e.ids) for e in found]

    def _of_chunks(self, chunks: list[str]) -> list[bytes]:
        return self._joined([self.plain.findall(c if self.words else " " + c) for c in chunks], self.kept, self._of_pieces)

    def _joined(self, lists: list[list[str]], kept: Kept, make) -> list[bytes]:
        flat = kept.ids(list(chain.from_iterable(lists)), make)
        ends = list(accumulate(map(len, lists)))
        return [b"".join(flat[i:j]) for i, j in zip([0, *ends], ends)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned integers of ``dtype``."""
        collects = gc.isenabled()
        gc.disable()  # nothing here makes cycles, and the collector would walk all that is kept
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        """Plain texts are
        cut at spaces into chunks, which hold whole pieces if no space has white space on
        both sides; a chunk's ids are kept like a piece's. What is cut by the pattern, or
        at white space only, comes before a text's chunks."""
        others, pieces, chunks = [], [], []
        for x in texts:
            o = p = c = ()
            if not (x.isascii() or _PLAIN.fullmatch(x)):
                o = self.any.findall(x)
            elif self.words:
                x = x.lower()
                if _SEPARATORS.search(x):
                    p = self.plain.findall(x)
                else:
                    c = x.split()
            elif "  " in x or _BOTH_SIDES.search(x):
                p = self.plain.findall(x)
            else:
                first, *c = x.split(" ")
                p = self.plain.findall(first)
            others.append(o)
            pieces.append(p)
            chunks.append(c)
        found = (self._joined(others, self.others, self._of_others), self._joined(pieces, self.kept, self._of_pieces), self._joined(chunks, self.chunks, self._of_chunks))
        return [o + p + c for o, p, c in zip(*found)]


def encoder(path: str) -> PieceEncoder:
    """This worker's encoder of a file; kept from task to task."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def chunks(texts: list[str | None], most: int = 2_000_000):
    """Index ranges of about ``most`` characters, so that memory follows neither the
    batch nor the table; null counts as empty."""
    at = size = 0
    for i, x in enumerate(texts):
        size += len(x or "")
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)
