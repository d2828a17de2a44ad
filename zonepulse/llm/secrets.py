"""Secret scanning: fixed patterns, and formats inferred from labelled credentials.

Fixed kinds, leftmost and non-overlapping each:

    assign  a credential name, an assignment sign, a value of ASSIGN_LEAST characters or more
    access  an access-key prefix and ACCESS_LEAST characters or more in all
    hex     lower-case hexadecimal runs of HEX_LEAST characters or more

Grammar inference adds to them. The values that the fixed kinds find in a bounded
sample of texts are the labelled credentials. Spelt in character classes, each
kind's strings become a prefix tree whose states are merged while they are
statistically compatible: the frequencies of their next symbols and, so that thin
branches add up their evidence over all depths, the distributions of what is left
to the end must agree within the Hoeffding bound at ALPHA. A state goes to the
nearest compatible one; children are tested where both have CHILD_LEAST strings.
Fixed lengths and prefixes so stay in the automaton, and strings without them fold
into loops. What a state has not seen is scored by the kind's overall frequencies.

All other candidates of a text (runs of CANDIDATE_LEAST token characters with a
digit and a letter, between signs of assignment and the spans of the fixed kinds)
are scored over their whole length by their likelihood per character, and if that is
low so are their parts between slashes, under the best automaton against a
background automaton of other long tokens and of ordinary words; those above a
threshold a character that is calibrated on both samples, or with odds of e^EVIDENCE
over all characters, are secrets of kind ``auto``. Without labelled
credentials nothing is added.

Bounds of the training sample: about SAMPLE_TEXTS texts (by hash), from these
SAMPLE_STRINGS strings a kind and SAMPLE_CHARS characters in all, those with the
smallest hashes, whatever the partitions; strings are whole.

Only the training sample is bounded; every text is scanned whole. Positions are
code points, ends exclusive.

Edge cases: null is empty and has no span. Repeated rows give repeated results.
Null ids are kept. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonepulse.llm.common import id_type, materialize, text_slices

KINDS = ("assign", "access", "hex", "auto")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST, CANDIDATE_LEAST = 6, 20, 24, 20
SAMPLE_TEXTS, SAMPLE_STRINGS, SAMPLE_CHARS = 20_000, 300, 1 << 15
ALPHA, CHILD_LEAST = 0.05, 5
#: Ordinary words have at least so many letters and come from one sampled text in so many.
WORD_LEAST, WORD_TEXTS = 4, 8
#: No token is a secret below this log-likelihood ratio per character, unless its whole length makes the odds e^EVIDENCE to one.
LEAST_MARGIN, EVIDENCE = 0.25, 5.0
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")
_LONG = re.compile(r"[A-Za-z0-9+/_.=-]{20,}")
_UNASSIGNED = re.compile(r"[A-Za-z0-9+/_.-]{20,}")
_WORD = re.compile(r"[^\W\d_]{%d,}" % WORD_LEAST)
_PART = re.compile(r"[A-Za-z0-9+_.-]{20,}")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CLASSES = str.maketrans({c: k for chars, k in (("0123456789", "d"), ("abcdef", "h"), ("ghijklmnopqrstuvwxyz", "l"), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "U")) for c in chars})
_END = "$"

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the fixed kinds, by start and then kind."""
    found: list[Span] = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    # both other kinds lie inside long runs of token characters
    for run in _LONG.finditer(text):
        s, e = run.span()
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text, s, e) if m.end() - m.start() >= ACCESS_LEAST]
        found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text, s, e)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def _mixed(value: str) -> bool:
    return len(value) >= CANDIDATE_LEAST and re.search("[0-9]", value) is not None and re.search("[A-Za-z]", value) is not None


def candidates(text: str, taken: list[Span]) -> Iterator[tuple[int, int, str]]:
    """Other token runs that mix digits and letters: (start, end, string)."""
    spans, first = sorted((a, b) for a, b, _ in taken), 0
    for run in _LONG.finditer(text):
        s, e = run.span()
        while first < len(spans) and spans[first][1] <= s:
            first += 1
        rest, at = [], s  # what the spans leave of the run
        for a, b in spans[first:]:
            if a >= e:
                break
            rest.append((at, a))
            at = max(at, b)
        for low, high in [*rest, (at, e)]:
            for part in _UNASSIGNED.finditer(text, low, max(low, high)):
                value = part.group().rstrip(".-")
                if _mixed(value):
                    yield part.start(), part.start() + len(value), value


class Automaton:
    """Probabilistic deterministic automaton learnt by merging prefix-tree states."""

    def __init__(self, strings: list[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[Counter] = [Counter()]
        self.left: list[Counter] = [Counter()]  # symbols to the end, the end itself included
        for text in strings:
            state, spelt = 0, text.translate(_CLASSES)
            for k, c in enumerate(spelt):
                self.count[state][c] += 1
                self.left[state][len(spelt) - k] += 1
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.count.append(Counter())
                    self.left.append(Counter())
                state = self.next[state][c]
            self.count[state][_END] += 1
            self.left[state][0] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()
        usual = sum(self.count, Counter())
        self.symbols = len(usual) + 1
        total = usual.total() + 0.5 * self.symbols
        self.usual = {c: (usual[c] + 0.5) / total for c in usual}
        self.rare = 0.5 / total

    def _apart(self, a: int, b: int) -> float:
        """How far the states differ, as a share of what the bound allows."""
        n, m = self.count[a].total(), self.count[b].total()
        most = max(abs(self.count[a][c] / n - self.count[b][c] / m) for c in self.count[a].keys() | self.count[b].keys())
        gap = 0.0
        for k in sorted(self.left[a].keys() | self.left[b].keys()):
            gap += self.left[a][k] / n - self.left[b][k] / m
            most = max(most, abs(gap))
        return most / (self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m)))

    def _distance(self, a: int, b: int) -> float:
        """The states' own distance; above 1 if they or states behind them are incompatible."""
        own = self._apart(a, b)
        todo = [(a, b)] if own <= 1 else []
        seen = set()
        while todo:
            a, b = todo.pop()
            for c, t in self.next[b].items():
                s = self.next[a].get(c)
                if s is None or (s, t) in seen or min(self.count[a][c], self.count[b][c]) < CHILD_LEAST:
                    continue
                seen.add((s, t))
                if self._apart(s, t) > 1:
                    return 2.0
                todo.append((s, t))
        return own

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b to the state a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.count[a] += self.count[b]
            self.left[a] += self.left[b]
            for c, t in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], t))
                else:
                    self.next[a][c] = t

    def _merge(self) -> None:
        kept, edge = [0], [(0, c) for c in self.next[0]]
        while edge:
            # the most frequent open state first, by its place in the order on ties
            state, c = min(edge, key=lambda x: (-self.count[self.next[x[0]][x[1]]].total(), x))
            new = self.next[state][c]
            far, old = min((self._distance(x, new), k) for k, x in enumerate(kept))
            if far <= 1:
                self.next[state][c] = kept[old]
                self._fold(kept[old], new)
            else:
                kept.append(new)
            known = set(kept)
            edge = [(s, x) for s in kept for x, t in self.next[s].items() if t not in known]
        place = {s: k for k, s in enumerate(kept)}
        self.next, self.count = [{c: place[t] for c, t in self.next[s].items()} for s in kept], [self.count[s] for s in kept]

    def score(self, text: str) -> float:
        """Log likelihood per symbol; one case of the overall frequencies is added to each state."""
        state, total, spelt = 0, 0.0, text.translate(_CLASSES) + _END
        for c in spelt:
            usual = self.usual.get(c, self.rare)
            if state >= 0:
                seen = self.count[state]
                usual = (seen[c] + usual) / (seen.total() + 1)
                state = self.next[state].get(c, -1)
            total += math.log(usual)
        return total / len(spelt)


class Grammar:
    """Automata of the labelled kinds, one of the background, and the threshold.

    background: other long tokens; words: ordinary words, which join them, so that
    likelihoods are always held against the language's own.
    """

    def __init__(self, labelled: dict[str, list[str]], background: list[str], words: list[str] | None = None):
        background = background + (words or [])
        self.kinds = {k: Automaton(v) for k, v in sorted(labelled.items()) if v}
        self.background = Automaton(background) if background else None
        known = [self.margin(x) for v in labelled.values() for x in v]
        plain = [self.margin(x) for x in background]
        # half-way between weak credentials and ordinary tokens, of which some may be credentials
        weak, usual = float(np.quantile(known, 0.05)) if known else math.inf, float(np.quantile(plain, 0.9)) if plain else 0.0
        self.threshold = max(LEAST_MARGIN, (weak + max(usual, 0.0)) / 2)

    def margin(self, text: str) -> float:
        if not self.kinds:
            return -math.inf
        # what the background has never seen is at least as likely as a draw of classes
        return max(a.score(text) for a in self.kinds.values()) - max(self.background.score(text) if self.background else -math.inf, -math.log(6))

    def likely(self, value: str) -> bool:
        """By the ratio of each character, or by that of all of them."""
        margin = self.margin(value)
        return margin > self.threshold or margin * (len(value) + 1) > EVIDENCE

    def found(self, at: int, value: str) -> Iterator[tuple[int, int]]:
        """Where the candidate at ``at`` is a secret: whole, else its parts between slashes."""
        if not self.kinds:
            return
        if self.likely(value):
            yield at, at + len(value)
        elif "/" in value:
            for m in _PART.finditer(value):
                part = m.group().rstrip(".-")
                if _mixed(part) and self.likely(part):
                    yield at + m.start(), at + m.start() + len(part)

    def spans(self, text: str) -> list[Span]:
        """All spans, by start and then kind."""
        base = base_spans(text)
        more = [(a, b, "auto") for s, _, value in candidates(text, base) for a, b in self.found(s, value)]
        return sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2])))


def learn(docs: DataFrame, text_col: str = "text", sample_texts: int = SAMPLE_TEXTS, sample_strings: int = SAMPLE_STRINGS) -> Grammar:
    """Infer the automata from a bounded hash sample of texts."""
    rows = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null")
    share = min(1.0, sample_texts / max(1, rows.count()))
    drawn = rows.where(F.pmod(F.xxhash64(F.lit("secrets"), "text"), F.lit(1 << 20)) < share * (1 << 20))
    kinds = (*KINDS, "word")

    def place(value: str) -> tuple[int, str]:
        return xxhash.xxh64_intdigest(value.encode()) >> 1, value

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, set[str]] = {k: set() for k in kinds}
        for _, texts in text_slices(batches, "text"):
            for raw in texts:
                text = raw.decode("utf-8", "replace")
                base = base_spans(text)
                for s, e, kind in base:
                    found[kind].add(_ASSIGN.match(text, s).group(2) if kind == "assign" else text[s:e])
                found["auto"].update(value for _, _, value in candidates(text, base))
                if zlib.crc32(raw) % WORD_TEXTS == 0:
                    found["word"].update(_WORD.findall(text))
            for kind, values in found.items():
                if len(values) > sample_strings:
                    found[kind] = set(sorted(values, key=place)[:sample_strings])
        pairs = [(k, *place(v)) for k in kinds for v in found[k] if len(v) <= SAMPLE_CHARS]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.string()))], ["kind", "hash", "value"])

    values = materialize(drawn.mapInArrow(gather, "kind string, hash long, value string").distinct(), "credentials")
    sizes = {r[0]: r[1] for r in values.groupBy("kind").count().collect()}
    # of a kind with many strings those up to a quantile that lies well behind the last one needed
    many = {k: 3 * sample_strings / n for k, n in sizes.items() if n > 3 * sample_strings}
    if many:
        cuts = values.agg(*[F.percentile_approx(F.when(F.col("kind") == k, F.col("hash")), share, 10_000).alias(k) for k, share in sorted(many.items())]).first().asDict()
        limit = F.create_map(*[F.lit(x) for kv in sorted(cuts.items()) for x in kv])
        values = values.where(F.col("hash") <= F.coalesce(F.try_element_at(limit, F.col("kind")), F.lit((1 << 63) - 1)))
    by: dict[str, list[str]] = {kind: [] for kind in kinds}
    held = dict.fromkeys(kinds, 0)
    seen = Counter()
    for kind, _, value in sorted(map(tuple, values.select("kind", "hash", "value").toLocalIterator())):
        seen[kind] += 1
        if seen[kind] <= sample_strings and held[kind] + len(value) <= SAMPLE_CHARS:
            held[kind] += len(value)
            by[kind].append(value)
    return Grammar({k: by[k] for k in KINDS[:3]}, by["auto"], by["word"])


def scan(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, spans as array of (start, end, kind)."""
    bound = docs.sparkSession.sparkContext.broadcast(grammar)
    kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches, "text"):
            found = [[{"s": s, "e": e, "kind": k} for s, e, k in bound.value.spans(t.decode("utf-8", "replace"))] for t in texts]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(found, kind)], ["id", "spans"])

    own = id_type(docs, id_col)
    rows = docs.select(F.col(id_col).cast(own).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {own}, spans array<struct<s:long,e:long,kind:string>>")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each covered stretch replaced by its first kind in brackets."""
    out, at = [], 0
    for s, e, kind in spans:
        if s >= at:
            out += [text[at:s], f"[{kind}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """docs with secrets in the text replaced; length_col, if named, is counted anew.

    Null texts stay null. All rows and the order of columns are kept.
    """
    bound = docs.sparkSession.sparkContext.broadcast(learn(docs, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches, text_col):
            at = rows.schema.get_field_index(text_col)
            missing = rows.column(at).is_null().to_pylist()
            clean = []
            for raw, null in zip(texts, missing, strict=True):
                text = raw.decode("utf-8", "replace")
                clean.append(None if null else redacted(text, bound.value.spans(text)))
            columns = rows.columns
            columns[at] = pa.array(clean, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=rows.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    if length_col:
        out = out.withColumn(length_col, F.coalesce(F.length(text_col).cast(docs.schema[length_col].dataType), F.col(length_col)))
    return out
