"""Known names in running text: one automaton a task finds all of them in one pass.

Texts and names are compared in lower case without accents. The names form an
Aho-Corasick automaton; a hit counts if no letter or digit touches it on either side. Of
hits that overlap the longest counts, of equally long ones the first.

The names travel to the tasks as one table, which is checked against ``MOST_BYTES``; a
larger one is dealt into blocks of that size, and the texts are read once a block.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of names in one automaton; its nodes take some tens of bytes each.
MOST_BYTES = 4 << 20


def _plain(char: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFD", char.lower()) if unicodedata.category(x) != "Mn")


class Plain(dict):
    """A table for str.translate, filled as characters come: lower case, no marks."""

    def __missing__(self, code: int) -> str:
        self[code] = found = _plain(chr(code))
        return found


def folded(text: str, table: Plain) -> tuple[str, list[int] | None]:
    """The text in plain form, and for each of its characters the place in the text (None: the same)."""
    out = text.translate(table)
    if len(out) == len(text) and all(len(x) == 1 for x in set(map(table.__getitem__, set(map(ord, text))))):
        return out, None
    return out, [k for k, c in enumerate(text) for _ in table[ord(c)]]


def automaton(names: list[str], table: Plain) -> ahocorasick.Automaton:
    """Of the plain forms of names; of names with one form the smallest stands for all."""
    found = ahocorasick.Automaton()
    for name in sorted(names, reverse=True):
        key = " ".join(name.translate(table).split())
        if key:
            found.add_word(key, (len(key), name))
    found.make_automaton()
    return found


def hits(text: str, names: ahocorasick.Automaton, table: Plain, every: bool = False) -> list[tuple[int, int, str]]:
    """(start, end, name) of the hits that count, or of every one, in the order of the text, in characters of the text."""
    plain, places = folded(text, table)
    found = []
    for last, (size, name) in names.iter(plain):
        start, end = last - size + 1, last + 1
        if not (start and plain[start - 1].isalnum()) and not (end < len(plain) and plain[end].isalnum()):
            found.append((start, end, name))
    # the longest of those that overlap, then the first
    taken, kept = bytearray(len(plain)), []
    for start, end, name in sorted(found, key=lambda x: (x[0] - x[1], x[0])):
        if every or not any(taken[start:end]):
            taken[start:end] = b"\x01" * (end - start)
            kept.append((start, end, name))
    return [(s, e, n) if places is None else (places[s], places[e - 1] + 1, n) for s, e, n in sorted(kept)]


def mentions(docs: DataFrame, names: DataFrame, id_col: str, text_col: str, name_col: str = "name", most_bytes: int = MOST_BYTES) -> DataFrame:
    """(id, start, end, name) of every known name in every text, in code points; null texts and names have none.

    Words of a name stand behind one space each, in the text as in the name. names is a dictionary of places, kept on the driver as blocks of at most ``most_bytes`` each.
    """
    spark, known = docs.sparkSession, names.where(F.col(name_col).isNotNull()).select(F.col(name_col).cast("string")).distinct()
    blocks: list[list[str]] = [[]]
    size = 0
    for row in known.orderBy(name_col).toLocalIterator():
        if size > most_bytes:
            blocks.append([])
            size = 0
        blocks[-1].append(row[0])
        size += len(row[0].encode())
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {kind}, start long, end long, name string"
    out = None
    for block in blocks:
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            table = Plain()
            tool = automaton(held.value, table)
            for batch in batches:
                ids, starts, ends, found = [], [], [], []
                if len(tool):
                    for k, text in enumerate(batch.column(1).to_pylist()):
                        for start, end, name in hits(text, tool, table, len(blocks) > 1):
                            ids.append(k)
                            starts.append(start)
                            ends.append(end)
                            found.append(name)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(found, pa.string())], ["id", "start", "end", "name"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if len(blocks) == 1 else _longest(out)


def _longest(found: DataFrame) -> DataFrame:
    """Hits of several blocks once more: a text's hits meet, and those inside longer ones go."""
    spans = F.array_sort(F.collect_list(F.struct((F.col("start") - F.col("end")).alias("size"), "start", "end", "name")))
    free = lambda kept, x: ~F.exists(kept, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"]))
    none = F.filter(F.col("spans"), lambda _: F.lit(False))
    kept = F.aggregate("spans", none, lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return found.groupBy("id").agg(spans.alias("spans")).select("id", F.explode(kept).alias("x")).select("id", "x.start", "x.end", "x.name")
