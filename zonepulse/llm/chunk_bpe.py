"""BPE encoding and decoding of whole texts by reuse of content-defined chunks.

A rolling hash over ``WINDOW`` bytes cuts each text where the content says so, so
that passages shared by documents fall into the same chunks wherever they stand.
Each distinct chunk is encoded once and kept in a worker's store of bounded size: of
plain Latin text by words that the library has encoded before, of other text by the
library as a whole. A cut may fall inside a word, so every join of two chunks is then
repaired: the text from a word start before the cut to some characters behind it is
encoded again, further and further, until one of its words begins where a word of
the right chunk begins. Up to there the repaired ids count, from there those of the
chunk. Repairs are stored as well, by the pair of chunks.

Why that is exact: the pre-tokenizer drops white space and takes words from left to
right, looking at most ``AHEAD`` characters ahead, and each word is merged on its own.
So a word start that lies ``AHEAD`` characters before a cut is one of the whole text,
and from a start that both readings share on they agree for good. Starts count
only at characters that never compose with what stands before them (NFC). Texts
in which no such start turns up grow by doubling until one does or the text ends.
A text is first cut at the tokenizer's added tokens, as the library does.

Decoding takes the tokens of the ids and joins them by spaces, which is what the
library does where the tokenizer file names no decoder.

Edge cases: a null or empty text has no tokens and decodes to the empty string.
Repeated rows and rows with a null id are encoded each. Without rows the result is
empty. Other columns are ignored, whatever their names. Texts of any length are
encoded whole. A tokenizer whose words hold white space, that has a decoder, or
whose added tokens take white space with them raises ValueError.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonepulse.llm.common import id_type, text_slices

#: Bytes that decide about a cut, the usual, least and greatest bytes of a chunk.
WINDOW, USUAL, LEAST, MOST = 32, 512, 64, 4096
#: Characters that decide about a word at most.
AHEAD = 3
#: Characters behind a cut that a repair reads first.
REACH = 24
#: Word starts kept at either end of a chunk.
STARTS = 6
#: Bytes of chunks that a worker's store holds, in two generations.
STORE_BYTES = 24 << 20
SLICE = 1 << 20
#: Words whose ids a worker keeps.
WORDS = 1 << 17
#: Bytes that are hashed at once.
BLOCK = 1 << 20

_GEAR = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 64, 256, dtype=np.uint64)


def cuts(data: np.ndarray, ends: list[int]) -> list[list[int]]:
    """For texts that stand one after another in ``data`` (UTF-8 bytes) and end at ``ends``: the ends of their chunks.

    A place is wanted as a cut by the hash of the WINDOW bytes before it: the sum of a
    number per byte, shifted by its distance, built by doubling. LEAST is not below
    WINDOW, so no hash that counts reaches into the text before.
    """
    wanted: list[int] = []
    for at in range(0, len(data), BLOCK):
        first = max(0, at - WINDOW)
        code = _GEAR[data[first : at + BLOCK]]
        width = 1
        while width < WINDOW:
            code[width:] += code[:-width] << np.uint64(width)
            width *= 2
        wanted += (np.flatnonzero((code[at - first :] >> np.uint64(40)) % np.uint64(USUAL - LEAST) == 0) + at + 1).tolist()
    wanted = [i for i in wanted if i < len(data) and data[i] & 0xC0 != 0x80]  # no character is halved
    out, at, begin = [], 0, 0
    for end in ends:
        found, last = [], begin
        while True:
            while at < len(wanted) and wanted[at] < last + LEAST:
                at += 1
            cut = min(wanted[at] if at < len(wanted) else end, end)
            if cut - last > MOST:
                cut = last + MOST
                while data[cut] & 0xC0 == 0x80:
                    cut -= 1
            if cut >= end:
                break
            found.append(cut)
            last = cut
        found.append(end)
        out.append(found)
        begin = end
    return out


@functools.lru_cache(1 << 14)
def stands_alone(char: str) -> bool:
    """Whether NFC keeps the character apart from what stands before it."""
    if char < "\x80":
        return True
    jamo = "ᄀ" <= char <= "ᇿ" or "ꥠ" <= char <= "꥿" or "ힰ" <= char <= "퟿"
    return not jamo and unicodedata.category(char)[0] in "LNPS" and not unicodedata.combining(char) and unicodedata.is_normalized("NFC", char)


#: Text that NFC leaves as it is, in which upper and lower case have equal lengths; and its words.
PLAIN = re.compile("[ -~\n\r\tÀ-ÖØ-öø-ÿ]*")
WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\\[-`{-~]+")


class Chunk:
    """A piece of text with its own ids, and the word starts (character, token) at its two ends."""

    __slots__ = ("text", "ids", "head", "tail")

    def __init__(self, text: str, ids: bytes, head: list[tuple[int, int]], tail: list[tuple[int, int]]):
        self.text, self.ids, self.head, self.tail = text, ids, head, tail


class Store:
    """A dict of two generations: what was used since the last change of generation survives it."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old, self.size = limit // 2, {}, {}, 0

    def get(self, key):
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, *found)
        return found and found[0]

    def put(self, key, value, size: int) -> None:
        if self.size > self.limit:
            self.old, self.young, self.size = self.young, {}, 0
        self.young[key] = (value, size)
        self.size += size


class ChunkEncoder:
    """ids(texts): little-endian unsigned 32-bit ids of each text, as the library gives them for the whole text."""

    def __init__(self, path: str, store_bytes: int = STORE_BYTES):
        from tokenizers import Tokenizer

        # a task has one core: the library's idle threads would only spin on the others
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        added = self.tokenizer.get_added_tokens_decoder()
        spec = json.loads(self.tokenizer.to_str())
        probe = self.tokenizer.encode("a a  b", add_special_tokens=False)
        if spec.get("decoder") or [t for t in added.values() if t.normalized or t.lstrip or t.rstrip or t.single_word] or probe.offsets != [(0, 1), (2, 3), (5, 6)]:
            raise ValueError("chunks need a tokenizer without decoder that drops white space between words")
        self.special = {t.content.encode(): int(k).to_bytes(4, "little") for k, t in added.items()}
        longest = sorted(self.special, key=len, reverse=True)
        self.mark = re.compile(b"(" + b"|".join(map(re.escape, longest)) + b")") if longest else None
        n = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.tokens = pa.array([self.tokenizer.id_to_token(k) or "" for k in range(n)], pa.large_string())
        self.chunks, self.joins, self.words = Store(store_bytes), Store(store_bytes), {}
        # the byte-level alphabet: printable bytes stand for themselves, the others for 256 and on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
        probes = ["héßllo", "'re", "7", "-!_`", "über"]
        self.plain = [e.ids for e in self.tokenizer.encode_batch(probes, add_special_tokens=False)] == [np.frombuffer(self._word(w), "<u4").tolist() for w in probes]
        self.encoded = self.repaired = self.reused = 0

    def _word(self, word: str) -> bytes:
        """Ids of one word of lower case."""
        spelt = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
        return b"".join([t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(spelt)])

    def _words(self, low: str) -> tuple[list[str], list[bytes]]:
        """The words of plain text in lower case, and the ids of each."""
        known, words = self.words, WORD.findall(low)
        try:
            return words, list(map(known.__getitem__, words))
        except KeyError:
            if len(known) > WORDS:
                known.clear()
            for w in set(words).difference(known):
                known[w] = self._word(w)
            return words, list(map(known.__getitem__, words))

    def _library(self, texts: list[str]) -> list[tuple[bytes, list[tuple[int, int, int]]]]:
        """(ids, the begin, end and first token of each word) of texts of any kind."""
        out = []
        for code in self.tokenizer.encode_batch(texts, add_special_tokens=False) if texts else []:
            words, last = [], None
            for token, (word, (begin, end)) in enumerate(zip(code.word_ids, code.offsets, strict=True)):
                if word != last:
                    words.append((begin, end, token))
                else:
                    words[-1] = (words[-1][0], end, words[-1][2])
                last = word
            out.append((np.array(code.ids, "<u4").tobytes(), words))
        return out

    def _plain_chunk(self, text: str) -> Chunk:
        low = text.lower()
        words, ids = self._words(low)
        head = [m.start() for m in itertools.islice(WORD.finditer(low), STARTS)]
        head = list(zip(head, itertools.accumulate([len(x) // 4 for x in ids[: len(head)]], initial=0), strict=False))
        tail, end, raw = [], len(low), b"".join(ids)
        token = len(raw) // 4
        for word, x in zip(words[: -STARTS - 1 : -1], ids[::-1], strict=False):
            # behind the word there is white space alone
            end = len(low[:end].rstrip()) - len(word)
            token -= len(x) // 4
            tail.append((end, token))
        return Chunk(text, raw, head, tail)

    def _made(self, texts: list[str]) -> list[Chunk]:
        """Each text read on its own."""
        plain = [bool(self.plain and PLAIN.fullmatch(t)) for t in texts]
        rest = iter(self._library([t for t, p in zip(texts, plain, strict=True) if not p]))
        out = []
        for text, p in zip(texts, plain, strict=True):
            if p:
                out.append(self._plain_chunk(text))
                continue
            ids, words = next(rest)
            # a word that shares a character with the one before, or that NFC may join to it, is no start
            starts = [(begin, token) for k, (begin, _, token) in enumerate(words) if (k == 0 or begin >= words[k - 1][1]) and stands_alone(text[begin])]
            out.append(Chunk(text, ids, starts[:STARTS], starts[: -STARTS - 1 : -1]))
        return out

    def _windows(self, texts: list[str]) -> list[tuple[bytes, list[tuple[int, int, int]]]]:
        """(ids, the begin, end and first token of each word) of short texts."""
        plain = [bool(self.plain and PLAIN.fullmatch(t)) for t in texts]
        rest = iter(self._library([t for t, p in zip(texts, plain, strict=True) if not p]))
        out = []
        for text, p in zip(texts, plain, strict=True):
            if not p:
                out.append(next(rest))
                continue
            low = text.lower()
            _, ids = self._words(low)
            tokens = itertools.accumulate([len(x) // 4 for x in ids], initial=0)
            out.append((b"".join(ids), [(*m.span(), t) for m, t in zip(WORD.finditer(low), tokens, strict=False)]))
        return out

    def _chunks(self, keys: list[bytes]) -> list[Chunk]:
        """The chunk of each key, encoded now if the store lacks it."""
        found = {k: self.chunks.get(k) for k in dict.fromkeys(keys)}
        missing = [k for k, c in found.items() if c is None]
        for at in range(0, len(missing), 1024):
            part = missing[at : at + 1024]
            texts = [k.decode("utf-8", "replace") for k in part]
            for key, made in zip(part, self._made(texts), strict=True):
                found[key] = made
                self.chunks.put(key, made, 3 * len(key) + 400)
        self.encoded += len(missing)
        self.reused += len(keys) - len(missing)
        return [found[k] for k in keys]

    @staticmethod
    def _left(a: Chunk, true_from: tuple[int, int]) -> tuple[int, int]:
        """(character, token) of the last word start of ``a`` that the text behind it cannot change."""
        last = len(a.text) - AHEAD
        return next((s for s in a.tail if true_from[0] <= s[0] <= last), true_from)

    @staticmethod
    def _agreement(words: list[tuple[int, int, int]], a_chars: int, length: int, b: Chunk) -> tuple[int, int, int] | None:
        """(token of the window, character and token of b) of the first word that begins in both."""
        own = {begin - a_chars: token for (_, end, _), (begin, _, token) in itertools.pairwise(words) if begin >= max(a_chars, end) and begin + AHEAD <= length}
        return next(((own[s], s, k) for s, k in b.head if s in own), None)

    def _repair(self, pairs: list[tuple]) -> None:
        """Finds and stores the joins of (key, left chunk, its start, right chunk); None where the right chunk has no agreement."""
        reach, rest = REACH, pairs
        while rest:
            windows = [a.text[s:] + b.text[:reach] for _, a, (s, _), b in rest]
            again = []
            for pair, window, (ids, words) in zip(rest, windows, self._windows(windows), strict=True):
                key, a, (s, _), b = pair
                met = self._agreement(words, len(a.text) - s, len(window), b)
                if met:
                    join = (ids[: 4 * met[0]], met[1:])
                    self.joins.put(key, join, 200 + len(join[0]))
                elif not b.head or reach >= len(b.text) or len(b.head) == STARTS and reach > 4 * (b.head[-1][0] + REACH):
                    self.joins.put(key, (None, None), 200)
                else:
                    again.append(pair)
            self.repaired += len(rest)
            reach, rest = 4 * reach, again

    def _joined(self, keys: list[bytes], parts: list[Chunk]) -> bytes:
        """Ids of one text from its chunks."""
        out: list[bytes] = []
        a, key, true_from, k, n = parts[0], keys[0], (0, 0), 1, len(parts)
        while k < n:
            b = parts[k]
            left = self._left(a, true_from)
            name = (key, left[0], keys[k])
            join = self.joins.get(name) if key is not None else None
            if join is None:
                name = name if key is not None else (None, 0, b"")
                self._repair([(name, a, left, b)])
                join = self.joins.get(name)
            middle, met = join
            if middle is not None:
                out += [a.ids[4 * true_from[1] : 4 * left[1]], middle]
                a, key, true_from, k = b, keys[k], met, k + 1
                continue
            # no common start in b: one longer chunk, at least twice as long each time
            more = [a.text[true_from[0] :]]
            size, goal = 0, max(len(more[0]), 1)
            while k < n and size < goal:
                more.append(parts[k].text)
                size += len(parts[k].text)
                k += 1
            text = "".join(more)
            a, key, true_from = self._made([text])[0], None, (0, 0)
        out.append(a.ids[4 * true_from[1] :])
        return b"".join(out)

    def _plain(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts without added tokens."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts]).tolist()
        keys, whole, begin = [], memoryview(data).cast("B") if len(data) else memoryview(b""), 0
        for found in cuts(data, ends):
            row = []
            for cut in found:
                row.append(bytes(whole[begin:cut]))
                begin = cut
            keys.append(row)
        flat = self._chunks([k for row in keys for k in row])
        parts, at = [], 0
        for row in keys:
            parts.append(flat[at : at + len(row)])
            at += len(row)
        # the joins that every chunk read from its own start needs, in one batch; the others one by one
        wanted = {}
        for row, mine in zip(keys, parts, strict=True):
            for k in range(1, len(row)):
                left = self._left(mine[k - 1], (0, 0))
                name = (row[k - 1], left[0], row[k])
                if left[0] and name not in wanted and self.joins.get(name) is None:
                    wanted[name] = (name, mine[k - 1], left, mine[k])
        self._repair(list(wanted.values()))
        return [self._joined(row, mine) for row, mine in zip(keys, parts, strict=True)]

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Ids of whole texts in UTF-8."""
        rows = [self.mark.split(text) if self.mark else [text] for text in texts]
        done = iter(self._plain([p for row in rows for p in row[::2]]))
        return [b"".join([self.special[p] if k % 2 else next(done) for k, p in enumerate(row)]) for row in rows]

    def decoded(self, ids: list[bytes]) -> list[bytes]:
        """The decoded text of each row of ids, in UTF-8."""
        offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])])
        flat = self.tokens.take(pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int64)))
        joined = pc.binary_join(pa.LargeListArray.from_arrays(offsets, flat), pa.scalar(" ", pa.large_string()))
        return joined.cast(pa.large_binary()).to_pylist()


_OPEN: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder of this file; its store lives as long as the worker."""
    if path not in _OPEN:
        _OPEN[path] = ChunkEncoder(path)
    return _OPEN[path]


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids][, decoded]) of every text, by one pass without a shuffle."""
    frame = docs.select(F.col(id_col).cast(id_type(docs, id_col)).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {id_type(docs, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids + ", decoded string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for rows, texts in text_slices(batches, "text", SLICE):
            ids = coder.ids(texts)
            back = coder.decoded(ids)
            columns = [rows.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x).hexdigest() for x in back])]
            columns += [pa.array(ids, pa.binary())] * with_ids + [pa.array([x.decode() for x in back], pa.string())] * with_text
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids + ["decoded"] * with_text
            yield pa.RecordBatch.from_arrays(columns, names)

    return frame.mapInArrow(run, schema)
