"""Language identification by interpolated Kneser-Ney character models.

One model per language is trained on a bounded sample of labelled texts: raw
counts for the highest order, continuation counts below, absolute discounting,
interpolation down to the uniform distribution. Up to BLOCK_LANGS languages share one
sorted hash array per order; each entry carries the log probability of its n-gram in
each of them, already interpolated, and contexts carry the back-off weights used when
an n-gram is in none. So no n-gram takes room for more than BLOCK_LANGS languages,
however many there are. A text goes to the language with the lowest length-normalised
cross-entropy.

Rejection is calibrated on pieces of labelled texts kept out of the counts: one of
CALIBRATION_SHARE sampled pieces and, where there are more, as many characters again
as the sample has. For each language they give the mean cross-entropy and its spread
as a function of length, and over all languages the REJECT_QUANTILE of the
standardised excess that known texts show. A text is rejected if it exceeds
REJECT_MARGIN times that, or if it has no letter. With fewer than CALIBRATION_LEAST
pieces their largest excess counts, over a spread of SPREAD_LEAST nats or more; with
none only letterless texts are rejected.

The alphabet has the 65,534 letters most frequent in the sample; others are one
unknown letter to every language.

Bounds: the sample holds about MAX_CHARS characters per language and
MAX_TOTAL_CHARS in all (expected values of a hash sample of pieces; texts of more
than PIECE_CHARS characters enter by pieces of that length, or of less in small
languages, so that there are about PIECES pieces and more), so the model has at most ORDER n-grams per sampled character. Only
the training sample is bounded; every text is scored whole.

Edge cases: null, empty and letterless texts get ``und``, score 0 and are
rejected. Ties go to the language that sorts first. Without a labelled text all
rows are ``und``. Repeated rows give repeated results.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonepulse.llm.common import id_type, materialize, text_slices

ORDER = 4
MAX_CHARS = 1_000_000
MAX_TOTAL_CHARS = 64_000_000
CALIBRATION_SHARE = 8  # one piece in so many
PIECE_CHARS, PIECE_LEAST, PIECES = 4000, 60, 40 * CALIBRATION_SHARE
REJECT_MARGIN = 1.5
REJECT_QUANTILE = 0.999
CALIBRATION_LEAST, SPREAD_LEAST = 20, 0.25
#: Log probabilities (n-grams by languages) held at once.
SLICE_VALUES = 1 << 21
#: Languages that share their hash arrays.
BLOCK_LANGS = 8
_UNKNOWN, _GAP = 0, 1


def _letters() -> np.ndarray:
    """Code point of each code point's lower-cased letter or mark; 32 for anything else."""
    table = np.full(0x110000, 32, np.int32)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] in "LM":
            table[c] = ord(chr(c).lower()[0])
    return table


_TABLE: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_letters())
    return _TABLE[0]


def normalised(texts: list[bytes], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each behind ``pad`` spaces, and where each begins."""
    strings = [t.decode("utf-8", "replace") for t in texts]
    joined = ("\n" * pad) + ("\n" * (pad + 1)).join(strings) + "\n"
    begins = np.concatenate([[0], np.cumsum([len(s) + pad + 1 for s in strings])])[: len(strings)]
    codes = letter_table()[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
    gap = codes == 32
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    for k in range(pad):
        keep[begins + k] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    return codes[keep], np.append(at[begins], at[-1])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class HashArray:
    """Sorted 64-bit hashes with a value row each; the leading bits index the array."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        hashes = _mix(keys)  # a bijection: no two keys share a hash
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], np.ascontiguousarray(values[order].T, dtype=np.float32)
        self.bits = max(1, int(len(keys)).bit_length() + 1)
        self.first = np.searchsorted(self.hashes, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).astype(np.int32)
        self.hashes = np.append(self.hashes, np.uint64(0xFFFFFFFFFFFFFFFF))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        hashes = _mix(keys)
        at = self.first[(hashes >> np.uint64(64 - self.bits)).astype(np.int64)].astype(np.int64)
        there = self.hashes[at]
        on = np.flatnonzero(there < hashes)
        while len(on):
            at[on] += 1
            on = on[self.hashes[at[on]] < hashes[on]]
        return np.where((self.hashes[at] == hashes) & (at < self.values.shape[1]), at, -1)


class Block:
    """Models of a few languages: interpolated log probabilities by order, in shared hash arrays."""

    def __init__(self, per: list[dict[int, tuple[np.ndarray, np.ndarray]]], order: int, uniform: float):
        """per: of each language, by order, its n-grams' keys and counts."""
        self.size = len(per)
        self.grams, self.contexts = {}, {}
        self.floor = np.zeros(self.size, np.float32)
        for n in range(1, order + 1):
            mask = np.uint64((1 << 16 * (n - 1)) - 1)
            all_keys = np.unique(np.concatenate([x[n][0] for x in per]))
            all_ctx = np.unique(all_keys >> np.uint64(16)) if n > 1 else np.zeros(1, np.uint64)
            ctx_all = np.searchsorted(all_ctx, all_keys >> np.uint64(16)) if n > 1 else np.zeros(len(all_keys), np.int64)
            lower = self.log_probs(all_keys & mask, n - 1) if n > 1 else None
            probs, weights = np.zeros((len(all_keys), self.size), np.float32), np.zeros((len(all_ctx), self.size))
            for j, levels in enumerate(per):
                key, count = levels[n]
                one, two = (count == 1).sum(), (count == 2).sum()
                cut = min(0.95, max(0.05, one / (one + 2 * two))) if one + two else 0.5
                ctx = key >> np.uint64(16) if n > 1 else np.zeros(len(key), np.uint64)
                mine, where = np.unique(ctx, return_inverse=True)
                total, types = np.bincount(where, count), np.bincount(where)
                gamma = cut * types / total
                slot = np.searchsorted(all_ctx, mine)
                weights[slot, j] = np.log(gamma)  # unseen contexts hand on everything: log 1
                p = np.exp(weights[ctx_all, j]) * (uniform if lower is None else np.exp(lower[j].astype(np.float64)))
                p[np.searchsorted(all_keys, key)] += np.maximum(count - cut, 0) / total[where]
                probs[:, j] = np.log(p)
            self.grams[n], self.contexts[n] = HashArray(all_keys, probs), HashArray(all_ctx, weights)
            if n == 1:
                self.floor = (weights[0] + np.log(uniform)).astype(np.float32)

    def log_probs(self, keys: np.ndarray, n: int) -> np.ndarray:
        """(languages, keys): log probability of the last character of each n-gram."""
        if n == 0:
            return np.repeat(self.floor[:, None], len(keys), axis=1)
        at = self.grams[n].find(keys)
        out = self.grams[n].values[:, np.maximum(at, 0)]
        miss = np.flatnonzero(at < 0)
        if len(miss):
            lost = keys[miss]
            lower = self.log_probs(lost & np.uint64((1 << 16 * (n - 1)) - 1), n - 1)
            if n > 1:
                ctx = self.contexts[n].find(lost >> np.uint64(16))
                lower = lower + np.where(ctx >= 0, self.contexts[n].values[:, np.maximum(ctx, 0)], 0)
            out[:, miss] = lower
        return out


class Model:
    """Models of all languages over one alphabet, in blocks of languages."""

    def __init__(self, counts: pd.DataFrame, order: int = ORDER, block_langs: int | None = None):
        """counts: lang, gram (``order`` characters), n."""
        self.order, self.langs = order, sorted(counts["lang"].unique())
        chars = sorted(set("".join(counts["gram"])) - {" "})
        if len(chars) > (1 << 16) - 2:
            seen: Counter = Counter()
            for gram, n in zip(counts["gram"], counts["n"], strict=True):
                seen[gram[-1]] += n
            chars = sorted(sorted(chars, key=lambda c: (-seen[c], c))[: (1 << 16) - 2])
        self.alphabet = np.zeros(0x110000, np.uint16)
        self.alphabet[32] = _GAP
        self.alphabet[[ord(c) for c in chars]] = np.arange(2, len(chars) + 2)
        codes = np.frombuffer("".join(counts["gram"]).encode("utf-32-le"), "<u4").reshape(-1, order)
        keys = np.zeros(len(counts), np.uint64)
        for k in range(order):
            keys = (keys << np.uint64(16)) | self.alphabet[codes[:, k]].astype(np.uint64)
        number = pd.Categorical(counts["lang"], categories=self.langs).codes
        rows, n = np.argsort(number, kind="stable"), counts["n"].to_numpy(np.float64)
        bounds = np.searchsorted(number[rows], np.arange(len(self.langs) + 1))
        self.blocks = []
        step = block_langs or BLOCK_LANGS
        for first in range(0, len(self.langs), step):
            per = []
            for j in range(first, min(first + step, len(self.langs))):
                mine = rows[bounds[j] : bounds[j + 1]]
                key, where = np.unique(keys[mine], return_inverse=True)
                levels = {order: (key, np.bincount(where, n[mine]))}
                for size in range(order - 1, 0, -1):
                    low = levels[size + 1][0] & np.uint64((1 << 16 * size) - 1)
                    key, count = np.unique(low, return_counts=True)
                    levels[size] = (key, count.astype(np.float64))
                per.append(levels)
            self.blocks.append(Block(per, order, 1.0 / (len(chars) + 2)))
        self.offset, self.scale = np.zeros(len(self.langs)), np.ones(len(self.langs))
        self.limit = np.inf

    def log_probs(self, keys: np.ndarray, n: int) -> np.ndarray:
        """(languages, keys): log probability of the last character of each n-gram."""
        return np.concatenate([block.log_probs(keys, n) for block in self.blocks])

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) summed log probabilities and each text's scored characters."""
        pad = self.order - 1
        codes, begins = normalised(texts, pad)
        ids = self.alphabet[codes].astype(np.uint64)
        keys = np.zeros(len(ids) - pad, np.uint64)
        for k in range(self.order):
            keys = (keys << np.uint64(16)) | ids[k : k + len(keys)]
        sums, n = np.zeros((len(texts), len(self.langs))), np.diff(begins) - pad
        full = np.flatnonzero(n > 0)
        # where a text's n-grams begin and end: those that reach into the next text count for none
        cuts = np.stack([begins[:-1][full], begins[1:][full] - pad], axis=1).ravel()
        step = max(1 << 14, SLICE_VALUES // self.blocks[0].size)
        for a in range(0, len(keys), step):
            part = keys[a : a + step]
            edges = np.concatenate([[a], cuts[np.searchsorted(cuts, a, "right") : np.searchsorted(cuts, a + len(part))]])
            place = np.searchsorted(cuts, edges, "right") - 1
            inside = (place >= 0) & (place % 2 == 0)
            for j, logs in enumerate(x for block in self.blocks for x in block.log_probs(part, self.order)):
                # a text that spans slices gets a part from each
                found = np.add.reduceat(logs, edges - a, dtype=np.float64)
                np.add.at(sums[:, j], full[place[inside] // 2], found[inside])
        return sums, n

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Best language's number (-1: no letter), score, cross-entropy, scored characters, rejected."""
        sums, n = self.score(texts)
        blank = np.array([not has_letter(t) for t in texts], bool)
        best = sums.argmax(axis=1)
        top = sums[np.arange(len(best)), best]
        entropy = -top / np.maximum(n, 1)
        # posterior of the best, tempered: neighbouring characters are not independent
        gain = (sums - top[:, None]) / np.maximum(1.0, n / 50.0)[:, None]
        score = 1.0 / np.exp(gain).sum(axis=1)
        rejected = blank | (self.excess(entropy, n, best) > self.limit)
        return np.where(blank, -1, best), np.where(blank, 0.0, score), np.where(blank, 0.0, entropy), n, rejected

    def excess(self, entropy: np.ndarray, n: np.ndarray, lang: np.ndarray) -> np.ndarray:
        return (entropy - self.offset[lang]) / (self.scale[lang] * (1 + 4 / np.sqrt(np.maximum(n, 1))))

    def calibrate(self, entropy: np.ndarray, n: np.ndarray, lang: np.ndarray, margin: float) -> None:
        """Fit offset and spread per language, then the limit over all of them."""
        self.offset, self.scale = np.zeros(len(self.langs)), np.ones(len(self.langs))
        if not len(entropy):
            return
        few = len(entropy) < CALIBRATION_LEAST
        least = SPREAD_LEAST if few else 0.05
        for j in range(len(self.langs)):
            mine = lang == j
            # a language without a piece borrows from the others
            self.offset[j] = entropy[mine].mean() if mine.any() else entropy.max()
            self.scale[j] = max(least, entropy[mine if mine.any() else slice(None)].std())
        excess = self.excess(entropy, n, lang)
        self.limit = margin * max(3.0, float(excess.max() if few else np.quantile(excess, REJECT_QUANTILE)))


def has_letter(text: bytes) -> bool:
    if any(65 <= b <= 90 or 97 <= b <= 122 for b in text[:64]):
        return True
    return any(unicodedata.category(c)[0] == "L" for c in text.decode("utf-8", "replace"))


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, max_chars: int = MAX_CHARS, max_total: int = MAX_TOTAL_CHARS, margin: float = REJECT_MARGIN) -> Model | None:
    """Fit the models on a bounded hash sample of the rows with text and language."""
    rows = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.sum(F.length("text"))).toLocalIterator()}
    sizes = {k: v for k, v in sizes.items() if v}
    if not sizes:
        return None
    quota = min(max_chars, max_total // len(sizes))
    share = {k: min(1.0, quota / v) for k, v in sizes.items()}
    width = {k: min(PIECE_CHARS, max(PIECE_LEAST, int(v * share[k]) // PIECES)) for k, v in sizes.items()}
    per = lambda values: F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(values.items()) for x in kv]), F.col("lang"))
    key = F.coalesce("id", "text")
    hashed = rows.select("lang", F.xxhash64(F.lit("langid"), key).alias("draw"), F.xxhash64(F.lit("calibrate"), key).alias("hold"), "text")
    # texts of one piece are drawn here, the pieces of others below
    able = hashed.where((F.pmod("draw", F.lit(1 << 20)) < 2 * per(share) * (1 << 20)) | (F.length("text") > per(width)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in text_slices(batches, "text"):
            found: list[tuple[str, str, bool]] = []
            draws, holds = (piece.column(k).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for k in (1, 2))
            for k, lang in enumerate(piece.column(0).to_pylist()):
                text = texts[k].decode("utf-8", "replace")
                numbers = np.arange(max(1, -(-len(text) // width[lang])), dtype=np.uint64)
                own = [np.where(numbers == 0, x, _mix(x + numbers * np.uint64(0x9E3779B97F4A7C15))) for x in (draws[k], holds[k])]
                place = (own[0] & np.uint64((1 << 20) - 1)) / (1 << 20)
                drawn = np.flatnonzero(place < 2 * share[lang])
                held = (own[1] % np.uint64(CALIBRATION_SHARE) == 0) | (place >= share[lang])
                found += [(text[i * width[lang] : (i + 1) * width[lang]], lang, bool(held[i])) for i in drawn.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.bool_()))], ["text", "lang", "held"])

    # written, as what counts and what calibrates both read it; its size is bounded
    sample = materialize(able.mapInArrow(cut, "text string, lang string, held boolean"), "langid-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in text_slices(batches, "text"):
            codes, begins = normalised(texts, order - 1)
            whole = "".join(map(chr, codes.tolist()))
            by: dict[str, Counter] = {}
            for k, lang in enumerate(piece.column(1).to_pylist()):
                own = whole[begins[k] : begins[k + 1]]
                by.setdefault(lang, Counter()).update(own[i : i + order] for i in range(len(own) - order + 1))
            for lang, grams in by.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(list(grams)), pa.array(list(grams.values()), pa.int64())], ["lang", "gram", "n"])

    counts = sample.where("not held").select("text", "lang").mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if not len(counts):  # too few texts to keep any out
        counts = sample.select("text", "lang").mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if not len(counts):
        return None
    model = Model(counts, order)
    known = identify(sample.where("held"), model, None, "text").select("n", "entropy", "pred").where("pred is not null").toPandas()
    place = {x: j for j, x in enumerate(model.langs)}
    model.calibrate(known["entropy"].to_numpy(), known["n"].to_numpy(), known["pred"].map(place).to_numpy(int), margin)
    return model


def identify(docs: DataFrame, model: Model | None, id_col: str | None = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, pred (null: no letter), score, entropy (nats a character), n, rejected."""
    kind = id_type(docs, id_col) if id_col else "long"
    ids = F.col(id_col).cast(kind) if id_col else F.lit(None).cast(kind)
    rows = docs.select(ids.alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {kind}, pred string, score double, entropy double, n long, rejected boolean"
    if model is None:
        return rows.select("id", F.lit(None).cast("string").alias("pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("entropy"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("rejected"))
    bound = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bound.value
        for piece, texts in text_slices(batches, "text"):
            best, score, entropy, n, rejected = own.predict(texts)
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([own.langs[j] if j >= 0 else None for j in best], pa.string()), pa.array(score), pa.array(entropy), pa.array(n), pa.array(rejected)], ["id", "pred", "score", "entropy", "n", "rejected"])

    return rows.mapInArrow(run, schema)


def fold(id_col: str = "doc_id") -> Column:
    """0 to 4: the CRC-32 of the id as text, modulo 5; null ids are in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)), F.lit(0))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that are not rejected, with models fitted on docs' own labels.

    Without a labelled text there is no model to reject by: letterless texts go, as
    always, and all others stay.
    """
    model = train(docs, id_col, text_col, lang_col)
    bound = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in text_slices(batches, text_col):
            stays = [has_letter(t) for t in texts] if bound.value is None else ~bound.value.predict(texts)[4]
            yield piece.filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
