"""Tokenising whole texts with a tokenizers file, with a bounded cache of chunks.

A text is cut where its pre-tokenizer is certain to cut it: at a single space or
newline between two other characters. Arrow cuts a slice of texts and numbers the
distinct chunks; each distinct one is encoded on its own by the same library, and
a worker keeps the ids of up to ``CACHE`` of them. A chunk of Latin letters and
then punctuation is handed to the library's model as these two words, which any
of the pre-tokenizers make of it; other chunks go through the whole library, and
so does, in one piece, a text with any other white space or with one of the
tokenizer's added tokens spelt out. The ids are those of encoding the text in one
piece.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE = 1 << 17
#: Bytes of text that are cut and encoded at once.
SLICE = 2 << 20
#: White space other than single spaces and newlines, code points on which
#: libraries disagree about being white space, and the mark of a text's start.
_ODD = r"[ \n]{2}|[\x01\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"
_EDGE = r"^[ \n]|[ \n]\z"
_PLAIN = re.compile(r"""([ \n]?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([-!"#$%&()*+,./:;<=>?@\[\\\]^_`{|}~]*)""")
_START = "\x01"


class Encoder:
    """ids(texts) -> little-endian unsigned 32-bit ids of each text, as bytes.

    keep_space: whether white space belongs to the chunk that it precedes (byte
    level) or is dropped (word level).
    """

    def __init__(self, path: str, keep_space: bool, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = sorted({t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content})
        self.added = "(?i)" + "|".join(map(re.escape, added)) if added else None
        self.keep_space, self.limit, self.cache, self.short = keep_space, cache, {}, {}
        # byte-level alphabet: printable bytes stand for themselves, the others for 256 and on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}

    def _encode(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        """Ids of what is one word to the pre-tokenizer."""
        spelt = "".join(map(self.letters.__getitem__, word.encode()))
        return b"".join([t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(spelt)])

    def _marks(self, marks: str) -> bytes:
        if marks not in self.short and len(self.short) < 4096:
            self.short[marks] = self._word(marks)
        return self.short[marks] if marks in self.short else self._word(marks)

    def _plain(self, chunk: str) -> bytes | None:
        m = _PLAIN.fullmatch(chunk)
        if not m:
            return None if chunk else b""
        gap, word, marks = m.groups()
        if not self.keep_space:
            ids = self._word(word.lower())
        else:
            ids = self._marks(gap) + self._word(word) if gap == "\n" else self._word(gap + word)
        return ids + self._marks(marks) if marks else ids

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        known = self.cache
        out = list(map(known.get, chunks))
        missing = [k for k, ids in enumerate(out) if ids is None]
        rest = []
        for k in missing:
            out[k] = self._plain(chunks[k])
            if out[k] is None:
                rest.append(k)
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            for k, ids in zip(part, self._encode([chunks[k] for k in part]), strict=True):
                out[k] = ids
        room = self.limit - len(known)
        if room > 0:
            known.update((chunks[k], out[k]) for k in missing[:room])
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        rows = pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(rows, _ODD)
        if self.keep_space:
            odd = pc.or_(odd, pc.match_substring_regex(rows, _EDGE))
        if self.added:
            odd = pc.or_(odd, pc.match_substring_regex(rows, self.added))
        whole = np.flatnonzero(np.asarray(odd))
        out: list[bytes] = [b""] * len(texts)
        for k, ids in zip(whole.tolist(), self._encode([texts[k] for k in whole]), strict=True):
            out[k] = ids
        cut = np.flatnonzero(~np.asarray(odd))
        if not len(cut):
            return out
        rows = rows.take(pa.array(cut))
        if self.keep_space:
            rows = pc.replace_substring(rows, "\n", " \n")
            lists = pc.split_pattern(pc.binary_join_element_wise(pa.scalar(_START, pa.large_string()), rows, pa.scalar("", pa.large_string())), " ")
        else:
            lists = pc.split_pattern(pc.replace_substring(rows, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        # no chunk holds a space: one join and one cut are the fastest way to strings
        chunks = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), pa.scalar(" ", pa.large_string()))[0].as_py().split(" ")
        if self.keep_space:
            chunks = [c[1:] if c[:1] == _START else c if c[:1] == "\n" else " " + c for c in chunks]
        known = self._chunks(chunks)
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        begins = np.cumsum(sizes) - sizes
        codes, flat = np.asarray(coded.indices), np.frombuffer(b"".join(known), "<u4")
        n = sizes[codes]
        ends = np.cumsum(n)
        at = np.repeat(begins[codes] - (ends - n), n)
        at += np.arange(len(at))
        ids, stop = flat[at], np.concatenate([[0], ends])[np.asarray(lists.offsets)]
        for k, a, b in zip(cut.tolist(), stop[:-1].tolist(), stop[1:].tolist(), strict=True):
            out[k] = ids[a:b].tobytes()
        return out


_OPEN: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, keep_space: bool) -> Encoder:
    """The worker's encoder for this file; its cache lives as long as the worker."""
    if (path, keep_space) not in _OPEN:
        _OPEN[path, keep_space] = Encoder(path, keep_space)
    return _OPEN[path, keep_space]
