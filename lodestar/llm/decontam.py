"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to words (A-Z lower-cased, every other ASCII character a break),
joined by one space. Each benchmark item gives windows of ``window`` consecutive
words, or one window of all its words if it has fewer. The automaton holds all
windows, framed by spaces, and reads each document once; a match is a range of words,
which maps back to characters of the original text.

The automaton is shipped to all tasks only up to ``MAX_PATTERN_BYTES`` of window text.
A larger benchmark is cut into shards of that size; each shard is one further scan and
the matches are united by document row.

Edge cases: a null or empty text has no words; an item without words has no window and
never matches; equal items all match; repeated document rows give repeated results;
empty tables give empty results or no hits; null item ids match as words but are not
listed; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import fresh_name, map_rows, materialise

#: Bytes of windows that one automaton may hold; each byte takes about 60 bytes of memory.
MAX_PATTERN_BYTES = 4_000_000
#: Words in a window.
WINDOW = 10
#: Fixed value: the words of a text whose A-Z are lower-cased.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

_automata: dict[str, tuple] = {}


def words_of(text: str | None) -> list[bytes]:
    """The normalised words of a text, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def word_spans(text: str) -> list[tuple[int, int]]:
    """Character offsets of the same words in the original text."""
    return [m.span() for m in WORD.finditer(text.translate(_LOWER))]


def windows(items: DataFrame, window: int = WINDOW, key: str = "item_id", text: str = "text") -> DataFrame:
    """(pattern string, words int, items array): the distinct windows and the items that have them."""

    def run(batch: pa.RecordBatch) -> list:
        ids, patterns, sizes = [], [], []
        for item, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = words_of(t)
            for part in {b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))} if words else ():
                ids.append(item)
                patterns.append(part.decode("utf-8", "surrogatepass"))
                sizes.append(part.count(b" ") + 1)
        return [ids, patterns, sizes]

    kind = items.schema[key].dataType.simpleString()
    rows = map_rows(items.select(F.col(key), F.col(text).cast("string")), run, f"item {kind}, pattern string, words int")
    return rows.groupBy("pattern", "words").agg(F.collect_set("item").alias("items"))


def _automaton(shard) -> tuple:
    """The automaton of a shard: (token, broadcast list of (pattern, words, items)); kept by the worker under the token.

    The token is the driver's: an address in a worker may be that of an earlier broadcast.
    """
    token, shared = shard
    found = _automata.get(token)
    if found is None:
        patterns = shared.value
        machine = ahocorasick.Automaton()
        for at, (pattern, _, _) in enumerate(patterns):
            machine.add_word(f" {pattern} ", at)
        if patterns:
            machine.make_automaton()
        found = (machine, patterns)
        _automata.clear()
        _automata[token] = found
    return found


def _scan(text: str | None, machine, patterns) -> tuple[int, list[tuple[int, int]], set]:
    """Number of words, matched word ranges (end excluded, merged), matched items."""
    words = words_of(text)
    if not words or not patterns:
        return len(words), [], set()
    plain = (b" " + b" ".join(words) + b" ").decode("utf-8", "surrogatepass")
    spans: list[tuple[int, int]] = []
    items: set = set()
    seen: set[int] = set()
    done = at_word = 0
    for end, which in machine.iter(plain):
        at_word += plain.count(" ", done, end)  # `end` is the space after the last word
        done = end
        first = at_word - patterns[which][1]
        while spans and spans[-1][0] >= first:
            spans.pop()
        if spans and spans[-1][1] >= first:
            spans[-1] = (spans[-1][0], at_word)
        else:
            spans.append((first, at_word))
        if which not in seen:
            seen.add(which)
            items.update(patterns[which][2])
    items.discard(None)
    return len(words), spans, items


def _shards(spark, patterns: DataFrame, limit: int) -> Iterator:
    """(token, broadcast list of windows), each of ``limit`` bytes at most or one window."""
    patterns = materialise(patterns, "decontam-windows")
    total = patterns.agg(F.coalesce(F.sum(F.octet_length("pattern") + 2), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, -(-2 * int(total) // limit)) if total > limit else 1
    for k in range(shards):
        part = patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(shards)) == k).select("pattern", "words", "items")
        yield uuid.uuid4().hex, spark.sparkContext.broadcast([(r[0], r[1], r[2]) for r in part.collect()])  # at most about ``limit`` bytes


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", limit: int = MAX_PATTERN_BYTES) -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated, spans): one row per document row.

    ``spans`` are the hit passages as character ranges of the original text, end excluded.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    own = docs.select(F.col(key), F.col(text).cast("string").alias(text))
    shared = list(_shards(spark, windows(items, window, item_key, item_text), limit))
    schema = f"`{key}` {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, spans array<struct<start:int,end:int>>"

    def finish(t: str | None, n: int, spans: list[tuple[int, int]], items: list[str]) -> tuple:
        places = []
        if spans:
            at = word_spans(t)
            places = [{"start": at[a][0], "end": at[b - 1][1]} for a, b in spans]
        return n, sum(b - a for a, b in spans), len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), bool(spans), places

    if len(shared) == 1:
        one = shared[0]

        def run(batch: pa.RecordBatch) -> list:
            machine, patterns = _automaton(one)
            rows = []
            for t in batch.column(1).to_pylist():
                n, spans, found = _scan(t, machine, patterns)
                rows.append(finish(t, n, spans, sorted(map(str, found))))
            return [batch.column(0), *(list(zip(*rows, strict=True)) if rows else [[]] * 6)]

        return map_rows(own, run, schema)

    row, hits, items_of_row = (fresh_name(x, own) for x in ("row", "hits", "items"))
    numbered = materialise(own.withColumn(row, F.monotonically_increasing_id()), "decontam")
    parts = []
    for one in shared:

        def scan(batch: pa.RecordBatch, one=one) -> list:
            machine, patterns = _automaton(one)
            rows, spans_of, items_of = [], [], []
            for row, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _, spans, found = _scan(t, machine, patterns)
                if spans:
                    rows.append(row)
                    spans_of.append([{"a": a, "b": b} for a, b in spans])
                    items_of.append(sorted(map(str, found)))
            return [rows, spans_of, items_of]

        parts.append(map_rows(numbered.select(row, text), scan, f"`{row}` bigint, `{hits}` array<struct<a:int,b:int>>, `{items_of_row}` array<string>"))
    united = parts[0]
    for p in parts[1:]:
        united = united.unionByName(p)
    # at most one row per shard and document
    united = united.groupBy(row).agg(F.flatten(F.collect_list(hits)).alias(hits), F.array_sort(F.array_distinct(F.flatten(F.collect_list(items_of_row)))).alias(items_of_row))

    def unite(batch: pa.RecordBatch) -> list:
        rows = []
        for t, hits, found in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            spans: list[tuple[int, int]] = []
            for a, b in sorted((h["a"], h["b"]) for h in hits or ()):
                if spans and spans[-1][1] >= a:
                    spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
                else:
                    spans.append((a, b))
            rows.append(finish(t, len(words_of(t)), spans, sorted(found or ())))
        return [batch.column(0), *(list(zip(*rows, strict=True)) if rows else [[]] * 6)]

    joined = numbered.join(united, row, "left").select(key, text, hits, items_of_row)
    return map_rows(joined, unite, schema)


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", most: float = 0.0, **options) -> DataFrame:
    """The documents without those of which more than the share ``most`` of the words is hit by any window.

    Documents without words stay. Columns are kept as they are. ``most`` 0 drops every document that has a benchmark window.
    """
    spark = docs.sparkSession
    shared = list(_shards(spark, windows(items, options.get("window", WINDOW), options.get("item_key", "item_id"), options.get("item_text", "text")), options.get("limit", MAX_PATTERN_BYTES)))
    if most > 0 and len(shared) > 1:  # hits of several shards add up, so documents are judged on their union
        row = fresh_name("of_row", docs)
        numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "decontam-rows")
        hit = contamination(numbered, items, key=row, text=text, **options).where(F.col("n_hit") > most * F.col("n_words")).select(row)
        return numbered.join(hit, row, "left_anti").select(*docs.columns)
    at = docs.columns.index(text)
    out = docs
    schema = docs.schema
    for one in shared:  # the documents that one shard drops need no scan by the next

        def keep(batches: Iterator[pa.RecordBatch], one=one) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                machine, patterns = _automaton(one)
                ok = []
                for t in batch.column(at).to_pylist():
                    n, spans, _ = _scan(t, machine, patterns)
                    ok.append(sum(b - a for a, b in spans) <= most * n)
                yield batch.filter(pa.array(ok, pa.bool_()))

        out = out.mapInArrow(keep, schema)
    return out
