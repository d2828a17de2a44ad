"""Chunked BPE, the filter audit and Elkan's clusters against slow versions and edge rows."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonepulse.llm import chunk_bpe, elkan, filter_audit

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS, BYTES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ALPHABETS = [
    "abc de'sltrvm.,", "aé́ë ̧x", "日本語。、 a", "abİİ ", "'re 'll'd''ve ", " \t\n 　ab1", "한국어 각x", "क़क़ क", "😀👩‍🚀 !?",
    "<|endoftext|> <|startoftext|>ab", "12 ab34'", "োৗ a", "ß ΣςÅÅ x",
]


def library(texts):
    tool = tokenizers.Tokenizer.from_file(WORDS)
    return [e.ids for e in tool.encode_batch(texts, add_special_tokens=False)]


def numbers(raw):
    return [np.frombuffer(x, "<u4").tolist() for x in raw]


@pytest.mark.parametrize("sizes", [(512, 64, 4096), (40, 32, 48)])
def test_chunked_ids_equal_the_library(monkeypatch, sizes):
    for name, value in zip(("USUAL", "LEAST", "MOST"), sizes, strict=True):
        monkeypatch.setattr(chunk_bpe, name, value)
    rng = random.Random(sizes[0])
    texts = ["", " ", "a", "q" * 9000, "漢" * 5000, "é" * 4000, " " * 7000, "'" * 5000, "x" * 700 + " " * 700 + "y" * 700, "<|endoftext|>", "a<|endoftext|>" * 400]
    for letters in ALPHABETS:
        texts += ["".join(rng.choices(letters, k=rng.randint(1, 1500))) for _ in range(25)]
    passage = "".join(rng.choices("abcdefgh '.", k=3000))
    texts += [passage[k:] + " end" for k in range(0, 200, 7)]
    coder = chunk_bpe.ChunkEncoder(WORDS, 1 << 16)  # a store so small that generations change
    found = coder.ids([t.encode() for t in texts])
    assert numbers(found) == library(texts)
    assert numbers(coder.ids([t.encode() for t in texts])) == library(texts)
    tool = tokenizers.Tokenizer.from_file(WORDS)
    assert [x.decode() for x in coder.decoded(found)] == [tool.decode(x, skip_special_tokens=False) for x in numbers(found)]


def test_shared_passages_are_encoded_once():
    rng = random.Random(5)
    passage = " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(4000))
    coder = chunk_bpe.ChunkEncoder(WORDS)
    coder.ids([passage.encode()])
    alone, repaired = coder.encoded, coder.repaired
    shifted = [f"{'x' * k} {passage}".encode() for k in range(1, 9)]
    assert numbers(coder.ids(shifted)) == library([t.decode() for t in shifted])
    assert alone > 25 and coder.encoded - alone <= 3 * 8 and coder.repaired - repaired <= 6 * 8


def test_cuts_follow_the_content_and_keep_characters_whole(monkeypatch):
    rng = random.Random(6)
    text = "".join(rng.choices("abcdefg éü漢", k=20000))
    whole = np.frombuffer(text.encode(), np.uint8)
    [one] = chunk_bpe.cuts(whole, [len(whole)])
    monkeypatch.setattr(chunk_bpe, "BLOCK", 777)
    assert chunk_bpe.cuts(whole, [len(whole)]) == [one]
    for a, b in itertools.pairwise([0, *one]):
        text.encode()[a:b].decode()
        assert b - a <= chunk_bpe.MOST
    before = "zz ".encode()
    both = np.frombuffer(before + text.encode(), np.uint8)
    first, second = chunk_bpe.cuts(both, [len(before), len(both)])
    assert first == [3] and [k - 3 for k in second] == one


def test_long_runs_without_a_word_start_take_linear_work():
    coder = chunk_bpe.ChunkEncoder(WORDS)
    text = "́" * 300_000  # marks never stand alone
    assert numbers(coder.ids([text.encode()])) == library([text])


def test_encode_decode_rows(spark):
    texts = [None, "", "a b", "same", "same", "x" * 30000 + " <|endoftext|>é"]
    docs = spark.createDataFrame([(k if k != 3 else None, t, "a", 1, b"i") for k, t in enumerate(texts)], "doc_id long, text string, id string, n_tokens int, ids binary")
    rows = chunk_bpe.encode_decode(docs, WORDS, with_ids=True, with_text=True).collect()
    tool = tokenizers.Tokenizer.from_file(WORDS)
    assert len(rows) == 6 and sorted((r["id"] is None, r["id"] or 0) for r in rows) == [(False, 0), (False, 1), (False, 2), (False, 4), (False, 5), (True, 0)]
    for r in rows:
        ids = tool.encode(texts[3 if r["id"] is None else r["id"]] or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        text = tool.decode(ids, skip_special_tokens=False)
        assert r["decoded"] == text and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert not chunk_bpe.encode_decode(docs.where("false"), WORDS).collect()
    named = docs.withColumn("doc_id", F.lit("k"))
    assert {r["id"] for r in chunk_bpe.encode_decode(named, WORDS).collect()} == {"k"}


def test_tokenizers_that_keep_spaces_are_refused():
    with pytest.raises(ValueError):
        chunk_bpe.ChunkEncoder(BYTES)


def slow_audit(docs, labels):
    texts = collections.defaultdict(set)
    for key, text, _ in docs:
        if key is not None:
            texts[text or ""].add(key)
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, t in labels if t == 1 and k is not None}
    rows = []
    for key, text, part in docs:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        fails = set()
        if len(words) < 100:
            fails.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text):
            fails.add("C")
        if re.search("[#$%&*|]", text):
            fails.add("D")
        if key is not None and any(k < key for k in texts[text]):
            fails.add("E")
        rows.append((part or "", fails, key in good, key in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        shapley = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            mine = list(left)
            for step, f in enumerate(order, 1):
                lost = [r for r in left if f in r[1]]
                gone = [r for r in mine if f in r[1] and set(order[: step - 1]) & r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(lost)
                out[part, "".join(order), step] = [len(left), len(lost), len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in lost), sum(r[3] for r in lost), f]
        for (p, _, _), row in out.items():
            if p == part:
                row[6] = shapley[row[6]] if isinstance(row[6], str) else row[6]
    return out


def audit_rows(rng):
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=4))
    texts = [None, "", "", " ", "A" * 50, "é" * 9 + "B", " ".join(word() for _ in range(100)), "a b " * 60, "x # y", "\x0b".join(word() for _ in range(150)), "a b " * 120]
    texts += [" ".join(rng.choice(["AB", word(), word(), "$", "q"]) for _ in range(rng.randint(1, 220))) for _ in range(40)]
    docs = [(k if rng.random() < 0.95 else None, rng.choice(texts), rng.choice(["en", "de", None, ""])) for k in range(300)]
    docs += [docs[5], docs[5], (3, "other", "en"), (7, "", "en"), (7, "", None)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 200)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (999, 1, 1)]
    return docs, labels


@pytest.mark.parametrize("parts", [64, 1])
def test_audit_equals_slow_version(spark, monkeypatch, parts):
    monkeypatch.setattr(filter_audit, "PARTS_AT_ONCE", parts)
    docs, labels = audit_rows(random.Random(parts))
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 as id", "'x' as part", "2 as failed", "3 as n", "4 as quality").repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "5 as id", "'t' as text")
    rows = filter_audit.audit(frame, marks).collect()
    found = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in (*filter_audit.COUNTS, "shapley")] for r in rows}
    assert len(rows) == len(found) == 600 * 3 and found == slow_audit(docs, labels)


def test_audit_without_rows_or_labels(spark):
    docs = spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert not filter_audit.audit(docs.where("false"), labels).collect()
    rows = filter_audit.audit(docs, labels).collect()
    assert len(rows) == 600 and {r["shapley"] for r in rows} == {0, 120} and sum(r["removed"] for r in rows) == 120


def test_one_text_in_all_rows_comes_down_to_few_counts(spark):
    docs = spark.range(40_000).selectExpr("id as doc_id", "'the same text' as text", "if(id % 2 = 0, 'en', 'de') as lang").repartition(8)
    labels = spark.range(1000).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    sets = filter_audit.failure_sets(docs, labels).collect()
    assert len(sets) <= 6 and sum(r["n"] for r in sets) == 40_000 and sum(r["n"] for r in sets if r["failed"] < 16) == 1


def slow_clusters(rows, k=16, rounds=3, size=64):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) and abs(x) * 64 < 2**53 for x in v)]
    seeds = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in seeds]
    assign = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))[::-1]
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in kept:
            groups[assign(v)[0]].append(v)
        centroids = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if groups[n] else c for n, c in enumerate(centroids)]
    out = [(i, *assign(v)) for i, v in kept]
    sums = collections.Counter()
    for _, n, d in out:
        sums[n] += d
    fits = lambda x: x if x < 2**63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return collections.Counter((i, n, fits(d), fits(sums[n]), fits(sum(sums.values())), digest[n]) for i, n, d in out)


def vectors(rng, n, spread, size=64):
    base = [[rng.uniform(-spread, spread) for _ in range(size)] for _ in range(10)]
    return [(k, [float(np.float32(x + rng.gauss(0, spread / 9))) for x in rng.choice(base)]) for k in range(n)]


def clustered(spark, rows, kind="float"):
    frame = spark.createDataFrame([(*r, 1, 2.0, [1]) for r in rows], f"vec_id long, embedding array<{kind}>, id int, cluster double, v array<int>")
    return collections.Counter(map(tuple, elkan.cluster(frame.repartition(3)).collect()))


@pytest.mark.parametrize("spread", [0.05, 3.0, 1e6])
def test_clusters_equal_slow_version(spark, spread):
    rng = random.Random(int(spread * 100))
    rows = vectors(rng, 260, spread)
    rows += [(900, None), (901, [1.0] * 63), (902, [None] * 64), (903, [float("nan")] * 64), (904, [float("inf")] * 64), (905, []), (None, [0.5] * 64), rows[3], rows[3], (7, [0.25] * 64)]
    rows += [(1000 + k, [0.0] * 64) for k in range(30)]  # many equal rows
    assert clustered(spark, rows) == slow_clusters(rows)


def test_ties_go_to_the_smaller_number(spark):
    rng = random.Random(8)
    rows = [(k, [float(rng.randint(-1, 1))] + [0.0] * 63) for k in range(200)] + [(500 + k, [rng.choice([-0.5, 0.5]), rng.choice([-0.5, 0.5])] + [0.0] * 62) for k in range(100)]
    assert clustered(spark, rows) == slow_clusters(rows)


def test_clusters_of_few_or_large_vectors(spark):
    assert not clustered(spark, [(1, None)])
    assert clustered(spark, [(None, [0.0] * 64)]) == {(None, None, None, None, None, None): 1}
    few = [(k, [float(k)] * 64) for k in range(5)]
    assert clustered(spark, few) == slow_clusters(few)
    rng = random.Random(9)
    large = vectors(rng, 60, 1e12) + vectors(rng, 20, 1.0) + [(200, [1e30] * 64)]
    assert clustered(spark, large) == slow_clusters(large)


def test_bounds_hold_and_save_distances():
    rng = random.Random(10)
    rows = np.array([[math.floor(64 * x) for x in v] for _, v in vectors(rng, 400, 2.0)])
    old = rows[:16].copy()
    cluster, upper, lower = elkan.first_assignment(rows, old)
    new = np.array([rows[cluster == c].sum(0) // max((cluster == c).sum(), 1) if (cluster == c).any() else old[c] for c in range(16)])
    shape = elkan.Geometry(new.tolist(), old.tolist())
    cluster, upper, lower, computed = elkan.reassign(rows, cluster, upper, lower, shape, new)
    exact = np.sqrt(((rows[:, None] - new[None]) ** 2).sum(2))
    assert (cluster == exact.argmin(1)).all() and (upper >= exact[np.arange(400), cluster]).all() and (lower <= exact).all()
    assert computed < 400 * 16 / 4
