"""Encode batches of texts with a public tokenizer file, each distinct stretch of text once.

Byte-level BPE never merges across its pre-tokens, and a space that a non-space character follows always begins one, as
does a newline between two non-space characters. So a text falls into stretches at such places, whose ids don't depend
on their surroundings. A batch is cut into stretches, the distinct ones are looked up in a cache that a worker process
keeps from task to task (bounded), and their ids are laid out by arrays. Texts with any other white space, or with two
such characters side by side, and all texts of other kinds of tokenizer, are encoded whole.
"""

from __future__ import annotations

import functools
import json
import os
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space other than space and newline, and the marks below.
OTHER_SPACE = "[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff\x00\x01]"
#: Texts that are encoded whole.
UNCUT = f"  |\n\n| \n|\n |{OTHER_SPACE}"
#: Marks of a text's begin and end among the stretches; a stretch behind a newline begins with it.
BEGIN, END = "\x00", "\x01"
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
#: Byte-level vocabularies write bytes that don't print as the letters from U+0100 on.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in PRINTED)}
#: Punctuation that no contraction begins with.
CLOSING = ".,;:!?)]}#$%&*+=/"
#: Bytes of text that other passes take at a time.
SLICE = 1 << 22
#: Stretches that each generation of a cache holds: about 100 MB for both. Steps among others take FEW.
CACHED, FEW = 500_000, 150_000


class Encoder:
    """``encode(texts)``: the ids of each text without special tokens, then ``end`` unless that is None."""

    def __init__(self, path: str, end: int | None = None, most: int = CACHED, longest: int = 48):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        pre, added = made.get("pre_tokenizer") or {}, made.get("added_tokens") or []
        self.by_stretch = (
            made.get("normalizer") is None
            and made.get("post_processor") is None
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex") is True
            and not pre.get("add_prefix_space")
            and not any(re.search(r"\s", x["content"]) or x.get("lstrip") or x.get("rstrip") or x["content"].strip(CLOSING) != x["content"] for x in added)
        )
        self.tokenize = self.tokenizer.model.tokenize
        self.one = self.word if LITTLE and self.by_stretch else self.whole
        self.newline = self.whole("\n")
        self.end = b"" if end is None else np.array([end], "<u4").tobytes()
        self.most, self.longest = most, longest
        #: Bytes of text to encode at a time.
        self.slice = 16 * most
        # two generations: when the new one is full, the old one goes
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.closings: dict[str, bytes] = {}

    def word(self, text: str) -> bytes:
        """Ids of a stretch. Latin letters behind at most a space are one pre-token: the model alone then does."""
        spaced = text[0] == " "
        body = text[1:] if spaced else text
        if body.isalpha():
            if body.isascii():
                return array("I", [t.id for t in self.tokenize(BYTE_LETTERS[32] + body if spaced else body)]).tobytes()
            if max(body) < "\u0250":
                return array("I", [t.id for t in self.tokenize(text.encode().decode("latin-1").translate(BYTE_LETTERS))]).tobytes()
        return self.whole(text)

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes() if LITTLE else np.array(ids, "<u4").tobytes()

    def fresh(self, piece: str) -> bytes:
        """Ids of a piece of a cut text: what lies between two spaces, or a mark and what follows it."""
        mark, rest = piece[:1], piece[1:]
        if mark == BEGIN or mark == "\n":
            return (self.newline if mark == "\n" else b"") + (self.one(rest) if rest else b"")
        return self.end if mark == END else self.one(" " + piece)

    def known(self, piece: str) -> bytes:
        """The same through the cache's older generation. Of a piece that punctuation closes only the word is kept."""
        found = self.old.get(piece)
        if found is None:
            word = piece.rstrip(CLOSING)
            if word and len(word) < len(piece) and word[-1].isalpha():
                # letters end a pre-token where punctuation begins
                return (self.new.get(word) or self.known(word)) + self.closing(piece[len(word) :])
            found = self.fresh(piece)
        if len(piece) <= self.longest:
            if len(self.new) >= self.most:
                self.old, self.new = self.new, {}
            self.new[piece] = found
        return found

    def closing(self, marks: str) -> bytes:
        if marks not in self.closings:
            if len(self.closings) > 1000:
                self.closings.clear()
            self.closings[marks] = self.one(marks)
        return self.closings[marks]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, unsigned 32-bit; how many are each text's). A null text is empty."""
        texts = texts.fill_null("")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if not self.by_stretch:
            return self.together([self.whole(x) + self.end for x in texts.to_pylist()])
        uncut = pc.match_substring_regex(texts, UNCUT).to_numpy(zero_copy_only=False)
        if not uncut.any():
            return self.cut(texts)
        ids, counts = np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        apart = self.together([self.whole(x) + self.end for x in texts.filter(pa.array(uncut)).to_pylist()])
        rest = self.cut(texts.filter(pa.array(~uncut)))
        counts[uncut], counts[~uncut] = apart[1], rest[1]
        source = np.repeat(uncut, counts)
        ids = np.empty(len(source), np.uint32)
        ids[source], ids[~source] = apart[0], rest[0]
        return ids, counts

    def together(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        marked = pc.binary_join_element_wise(BEGIN, pc.replace_substring(texts, "\n", " \n"), " " + END, "")
        pieces = pc.split_pattern(marked, " ")
        ends = pieces.offsets.to_numpy()[1:] - pieces.offsets[0].as_py()
        coded = pieces.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        found = list(map(self.new.get, names))
        for k in [k for k, x in enumerate(found) if x is None]:
            found[k] = self.known(names[k])
        flat, sizes = self.together(found)
        del names, found
        which = coded.indices.to_numpy()
        lengths = sizes[which]
        stops = np.cumsum(lengths)
        at = np.repeat((np.cumsum(sizes) - sizes)[which] - (stops - lengths), lengths)
        at += np.arange(len(at))
        return flat[at], np.diff(stops[ends - 1], prepend=0)


@functools.lru_cache(maxsize=2)
def encoder(path: str, end: int | None = None, most: int = CACHED) -> Encoder:
    """One for each tokenizer and end id in a worker process, so that later tasks find what earlier ones cached."""
    return Encoder(path, end, most)


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most so many bytes of text each; a longer text is a part by itself."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, n = 0, batch.num_rows
    while at < n:
        base = int(sizes[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(sizes, base + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop
