"""Phrases whose words stand together more often than apart, from count tries.

A shard is a block of texts. Its trie has a level for each number of words up to ``DEPTH``; a node is (parent, word) with the
times its phrase occurs. Words are numbered in byte order, so each level is made by one sort of (parent, word) and comes out in the order of its
phrases. A trie is serialised in that order, cut at the borders of prefix ranges: for each range a row of the phrases and counts that begin
there. A range merges the sorted rows of all shards, as many as there are, and adds up equal phrases; from the root of the merged
trie it walks down to each phrase and hands the counts of all left parts on. Right parts come by suffix
links: the link of a phrase drops its first word, so its right parts are what it links to and the right parts of that.

Rare phrases never need to move. A phrase occurs as often as its rarest part at most, so three rounds count words, then pairs of
frequent words, then longer phrases of frequent pairs. What is frequent goes to the shards as a filter of ``FILTER_BITS`` bits, whatever the
corpus; phrases that it lets by wrongly cost time, and are dropped by their own counts. So all counts are exact.

Ranges are cut at samples of first pairs of words (``SAMPLE`` of them on average), so that no first word makes a range.

Edge cases: a null language is ``und``; null and empty texts have no words; words are cut at blanks and tabs alone, so any other character is part of one; words and
texts of any length are counted whole; repeated rows count repeatedly; ties go by count, then by the phrase's bytes; an empty
table, or one without frequent phrases, gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import operator
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import BATCH_ROWS, materialise

DEPTH, LEAST, TOP = 4, 30, 2000
#: Percent of a phrase's occurrences that lie in a longer phrase, from which it is dropped.
ABSORBED = 80
#: Bytes of text of one shard.
SHARD_BYTES = 12_000_000
#: Bits of the filters of frequent words and pairs.
FILTER_BITS = 1 << 27
_SEGMENT = 1 << 16
#: Pairs of words, on average, that tell where ranges are cut, one in so many of some documents; and bytes of text for each range.
SAMPLE, SPARED, RANGE_BYTES = 100_000, 16, 16_000_000
#: What ends a piece, what separates words; A-Z are lower-cased.
_ENDS, _BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b" \t"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)
_KIND[list(_BLANKS)] = 1
_KIND[list(_ENDS)] = 2
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9))
_BLOCK = "bucket int, lang string, words bigint, phrases binary, counts binary"


def word_ids(texts: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """Word number at each place, -1 between pieces, and the words in byte order."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    kind = _KIND[raw]
    inside = kind == 0
    edge = np.diff(np.concatenate([np.zeros(1, np.int8), inside.view(np.int8), np.zeros(1, np.int8)]))
    # a border of two texts may lie within a run of word bytes
    borders = ends[1:-1] - ends[0]
    borders = borders[(borders > 0) & (borders < len(raw))]
    borders = np.unique(borders[inside[borders] & inside[borders - 1]]) if len(borders) else borders
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(borders):
        starts, stops = np.sort(np.concatenate([starts, borders])), np.sort(np.concatenate([stops, borders]))
    if not len(starts):
        return np.zeros(0, np.int64), []
    values = _LOWER[raw[inside]]
    offsets = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int64)
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(values)]).dictionary_encode()
    names = coded.dictionary.to_pylist()
    order = sorted(range(len(names)), key=names.__getitem__)
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    ids = place[coded.indices.to_numpy()]
    # a piece ends where an end character, or the border of a text, lies before a word
    stops_before = np.searchsorted(np.flatnonzero(kind == 2), starts)
    texts_before = np.searchsorted(ends - ends[0], starts, "right")
    fresh = np.flatnonzero((stops_before[1:] > stops_before[:-1]) | (texts_before[1:] > texts_before[:-1])) + 1
    return np.insert(ids, fresh, -1), [names[i] for i in order]


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    h = first * _MIX[0] + (second ^ (second >> np.uint64(31))) * _MIX[1]
    h ^= h >> np.uint64(29)
    return h * _MIX[2]


def _bits(hashes: np.ndarray, lang: str) -> Iterator[np.ndarray]:
    """Places in a filter, two for each hash."""
    h = hashes ^ np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))
    for mix in _MIX[:2]:
        yield ((h * mix) >> np.uint64(64 - FILTER_BITS.bit_length() + 1)).astype(np.int64)


class Filter:
    """A set of hashes with false positives, no false negatives; of fixed size."""

    def __init__(self, segments: list[tuple[int, bytes]]):
        self.bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for k, data in segments:
            self.bits[k * _SEGMENT // 8 : (k + 1) * _SEGMENT // 8] = np.frombuffer(data, np.uint8)

    def has(self, hashes: np.ndarray, lang: str) -> np.ndarray:
        ok = np.ones(len(hashes), bool)
        for at in _bits(hashes, lang):
            ok &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return ok


def _filter_of(frequent: DataFrame) -> tuple[str, Broadcast]:
    """A token and the filter of the phrases (lang, phrase) of one or two words; its segments are made by tasks and have FILTER_BITS together."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list] = {}
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(phrase.encode().split(b" "))
            for lang, rows in by_lang.items():
                h = _hashes([r[0] for r in rows])
                pair = np.array([len(r) > 1 for r in rows])
                h[pair] = _pair_hashes(h[pair], _hashes([r[1] for r in rows if len(r) > 1]))
                at = np.unique(np.concatenate(list(_bits(h, lang))))
                yield pa.record_batch([pa.array((at // _SEGMENT).astype(np.int32)), pa.array((at % _SEGMENT).astype(np.int32))], names=["segment", "bit"])

    def pack(table: pa.Table) -> pa.Table:
        bits = np.zeros(_SEGMENT, np.uint8)
        bits[table.column("bit").to_numpy()] = 1
        return pa.table({"segment": pa.array([table.column("segment")[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    bits = frequent.select("lang", "phrase").mapInArrow(places, "segment int, bit int").distinct()
    rows = bits.groupBy("segment").applyInArrow(pack, "segment int, bits binary").collect()  # FILTER_BITS / _SEGMENT at most
    return uuid.uuid4().hex, frequent.sparkSession.sparkContext.broadcast([(r["segment"], bytes(r["bits"])) for r in rows])


_filters: dict[str, Filter] = {}


def _loaded(shared: tuple[str, Broadcast]) -> Filter:
    """The filter of a broadcast, built once by each worker; it keeps the two that came last."""
    token, segments = shared
    if token not in _filters:
        if len(_filters) > 1:
            _filters.pop(next(iter(_filters)))
        _filters[token] = Filter(segments.value)
    return _filters[token]


class Trie:
    """Count trie of a shard: for each level the word and the parent of each node, in the order of their phrases, and its count."""

    def __init__(self, ids: np.ndarray, words: list[bytes], depth: int, keep_words: np.ndarray | None = None, pairs: Filter | None = None, lang: str = ""):
        self.words, self.levels = words, []
        there = ids >= 0
        ok = there.copy()
        if keep_words is not None:
            ok[there] &= keep_words[ids[there]]
        node, parents = np.where(ok, ids, 0), np.zeros(len(words), np.int64)
        counts = np.bincount(ids[ok], minlength=len(words))
        self.levels.append((np.arange(len(words)), parents, counts))
        hashes = _hashes(words) if pairs is not None else None
        for level in range(2, depth + 1):
            # a phrase that ends here: the one a word shorter that ended before, and its suffix, which has to be there too
            both = np.flatnonzero(ok[1:] & ok[:-1]) + 1
            if level == 2 and pairs is not None and len(both):
                both = both[pairs.has(_pair_hashes(hashes[ids[both - 1]], hashes[ids[both]]), lang)]
            keys, inverse, counts = np.unique(node[both - 1] * len(words) + ids[both], return_inverse=True, return_counts=True)
            self.levels.append((keys % max(1, len(words)), keys // max(1, len(words)), counts))
            ok = np.zeros(len(ids), bool)
            ok[both] = True
            node = np.zeros(len(ids), np.int64)
            node[both] = inverse

    def phrases(self, level: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Phrases of a level in order, the numbers of their first two words (the second -1 if there is none), and their counts."""
        word, parent, counts = self.levels[level - 1]
        columns, node = [word], parent
        for back in range(level - 1, 0, -1):
            up_word, up_parent, _ = self.levels[back - 1]
            columns.append(up_word[node])
            node = up_parent[node]
        columns.reverse()
        names = pa.array(self.words, pa.large_binary())
        parts = [names.take(pa.array(c)) for c in columns]
        joined = parts[0] if level == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary()))
        return joined, columns[0] * (len(self.words) + 1) + (columns[1] + 1 if level > 1 else 0), counts


def _blocks(trie: Trie, levels: list[int], lang: str, cuts: list[tuple[bytes, bytes]], total: int) -> Iterator[tuple]:
    """Rows of the ranges: phrases of the levels and counts, each level in order, cut where the ranges are."""
    n = len(trie.words)
    # the borders as numbers of pairs: the least pair that isn't before a border
    borders, own = [], lang.encode()
    at_word = {w: i for i, w in enumerate(trie.words)}
    for cut_lang, cut in cuts:
        if cut_lang != own:
            borders.append(-1 if cut_lang < own else (n + 1) * (n + 1))
            continue
        first, _, second = cut.partition(b" ")
        i = at_word.get(first)
        if i is None:
            borders.append(bisect_left(trie.words, first) * (n + 1))
        else:
            borders.append(i * (n + 1) + (bisect_left(trie.words, second) + 1 if second else 0))
    for level in levels:
        phrases, pairs, counts = trie.phrases(level)
        live = np.flatnonzero(counts)
        if len(live) < len(counts):
            phrases, pairs, counts = phrases.take(pa.array(live)), pairs[live], counts[live]
        lines = pc.binary_join_element_wise(phrases, pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
        at, raw, counts = np.frombuffer(lines.buffers()[1], np.int64), memoryview(lines.buffers()[2] or b""), counts.astype("<i8")
        ends = [0, *np.searchsorted(pairs, np.array(borders, np.int64)).tolist(), len(pairs)]
        for bucket, (low, high) in enumerate(itertools.pairwise(ends)):
            if low < high:
                yield bucket, lang, 0, bytes(raw[at[low] : at[high] - 1]), counts[low:high].tobytes()
    yield len(cuts) + 1, lang, total, b"", b""


def _shards(docs: DataFrame, levels: list[int], cuts: Broadcast, keep: tuple[str, Broadcast] | None = None, pairs: tuple[str, Broadcast] | None = None) -> DataFrame:
    """Serialised tries of all shards; the row of the last bucket has the number of words."""

    def shard(lang: str, texts: list[pa.Array]) -> Iterator[tuple]:
        ids, words = word_ids(pa.concat_arrays(texts))
        kept = _loaded(keep).has(_hashes(words), lang) if keep is not None else None
        trie = Trie(ids, words, max(levels), kept, _loaded(pairs) if pairs is not None else None, lang)
        yield from _blocks(trie, levels, lang, cuts.value, int((ids >= 0).sum()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0
        for batch in itertools.chain((b.slice(i, BATCH_ROWS) for b in batches for i in range(0, b.num_rows, BATCH_ROWS)), [None]):
            if batch is not None:
                for lang in pc.unique(batch.column(0)).to_pylist():
                    held.setdefault(lang, []).append(batch.column(1).filter(pc.equal(batch.column(0), lang)).cast(pa.large_binary()))
                size += batch.column(1).nbytes
            if held and (batch is None or size >= SHARD_BYTES):
                for lang, texts in held.items():
                    for rows in itertools.batched(shard(lang, texts), 64):
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=[x.split()[0] for x in _BLOCK.split(", ")])
                held, size = {}, 0

    return docs.select("lang", "text").mapInArrow(run, _BLOCK)


def _merge(table: pa.Table) -> pa.Table:
    """Sums of the phrases of one range that are frequent, with the counts of their left parts of two words and more.

    The sort is one that finds runs which are in order and merges them, so each row, sorted by its shard, is read once for each doubling.
    """
    lang = table.column("lang")[0].as_py()
    entries: list[bytes] = []
    for p in table.column("phrases"):
        entries += p.as_py().split(b"\n")
    counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), "<i8")
    order = sorted(range(len(entries)), key=entries.__getitem__)
    entries = [entries[i] for i in order]
    fresh = np.fromiter(map(operator.ne, entries, [None, *entries[:-1]]), bool, len(entries))
    first = np.flatnonzero(fresh)
    sums = np.add.reduceat(counts[order], first)
    frequent = sums >= LEAST
    nodes = dict(zip([entries[i] for i in first[frequent]], sums[frequent].tolist(), strict=True))
    out = []
    for phrase, n in nodes.items():
        words = phrase.split(b" ")
        out.append((lang, len(words), phrase.decode(), n, [nodes[b" ".join(words[:k])] for k in range(2, len(words))]))  # down the trie
    types = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.list_(pa.int64()))
    columns = list(zip(*out, strict=True)) or [[]] * len(types)
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["lang", "m", "phrase", "f", "lefts"])


def _merged(blocks: DataFrame) -> DataFrame:
    return blocks.where(F.octet_length("phrases") > 0).groupBy("bucket", "lang").applyInArrow(_merge, "lang string, m int, phrase string, f bigint, lefts array<bigint>")


def _cuts(docs: DataFrame) -> Broadcast:
    """Where the ranges begin: (lang, first two words), from a sample of ``SAMPLE`` pairs of words on average."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / RANGE_BYTES))
    # of some documents one pair in SPARED; a word has some six bytes
    share = min(1.0, 6 * SPARED * max(SAMPLE, 10 * ranges) / max(1, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, pairs = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, words = word_ids(pa.array([text]))
                for i in range(0, len(ids) - 1, SPARED):
                    if ids[i] >= 0 and ids[i + 1] >= 0 and len(words[ids[i]]) + len(words[ids[i + 1]]) < 200:
                        langs.append(lang)
                        pairs.append((words[ids[i]] + b" " + words[ids[i + 1]]).decode())
            yield pa.record_batch([pa.array(langs, pa.string()), pa.array(pairs, pa.string())], names=["lang", "pair"])

    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30))).select("lang", "text")
    found = sorted(((r[0].encode(), r[1].encode()) for r in some.mapInArrow(run, "lang string, pair string").distinct().collect()), key=lambda x: (x[0], x[1].split(b" ")))
    return spark.sparkContext.broadcast([k for k, _ in itertools.groupby(found[i * len(found) // ranges] for i in range(1, ranges))] if found else [])


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def frequent_phrases(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Phrases of up to DEPTH words that occur LEAST times at least, as (lang, m, phrase, f, lefts, rights), and the number of words (lang, n).

    ``lefts``: counts of the first 1 to m - 1 words; ``rights``: of the last m - 1 to 1.
    """
    own = _own(docs)
    cuts = _cuts(own)
    first = materialise(_shards(own, [1], cuts), "phrases-words")
    total = first.where("words > 0").groupBy("lang").agg(F.sum("words").alias("n"))
    words = materialise(_merged(first), "phrases-of-one")
    keep = _filter_of(words)
    pairs = materialise(_merged(_shards(own, [2], cuts, keep)), "phrases-of-two")
    longer = materialise(_merged(_shards(own, list(range(2, DEPTH + 1)), cuts, keep, _filter_of(pairs))), "phrases-longer")

    # of a phrase: its first word's count, and by its suffix link all right parts
    none = F.array().cast("array<bigint>")
    out = level = words.select("lang", "m", "phrase", "f", none.alias("lefts"), none.alias("rights"))
    heads = words.select("lang", F.col("phrase").alias("head"), F.col("f").alias("head_f"))
    rows = longer.withColumns({"head": F.substring_index("phrase", " ", 1), "link": _without_first(F.col("phrase"))})
    rows = materialise(rows.join(heads, ["lang", "head"]).select("lang", "m", "phrase", "f", F.concat(F.array("head_f"), "lefts").alias("lefts"), "link"), "phrases-left")
    for m in range(2, DEPTH + 1):
        linked = level.select("lang", F.col("phrase").alias("link"), F.concat(F.array("f"), "rights").alias("rights"))
        level = materialise(rows.where(F.col("m") == m).join(linked, ["lang", "link"]).select("lang", "m", "phrase", "f", "lefts", "rights"), f"phrases-of-{m}-linked")
        out = out.unionByName(level)
    return out, total


def _without_first(phrase: Column) -> Column:
    return phrase.substr(F.instr(phrase, F.lit(" ")) + 1, F.char_length(phrase))


def _exact(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def collocations(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of two words and more that no longer phrase absorbs: their lowest-scoring cut."""
    cuts = F.transform(F.arrays_zip("lefts", "rights"), lambda x, k: F.struct(_score(F.col("f"), x["lefts"], x["rights"]).alias("score"), k.alias("k"), x["lefts"].alias("l"), x["rights"].alias("r")))
    rows = phrases.where("m > 1").select("lang", "m", "phrase", F.col("f").alias("a"), F.array_min(cuts).alias("cut"))
    # a phrase of one word more lies between any longer one and the phrase, and occurs as often as that at least
    both = F.array(_without_first(F.col("phrase")), F.array_join(F.slice(F.split("phrase", " "), F.lit(1), F.col("m") - 1), " "))
    around = rows.where("m > 2").select("lang", F.explode(both).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = rows.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (_exact(F.col("longer")) * 100 < _exact(F.col("a")) * ABSORBED))
    return left.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))


def _score(a: Column, left: Column, right: Column) -> Column:
    return F.call_function("div", _exact(a) * F.lit(2_000_000).cast("decimal(7,0)"), _exact(left) + _exact(right)).cast("bigint")


def top_phrases(docs: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` collocations of each language, by score and count descending, then by the phrase's bytes."""
    phrases, total = frequent_phrases(docs)
    by = (F.desc("score"), F.desc("a"), "phrase")
    found = collocations(phrases).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    # the first of each salt, so that no language is sorted in one task
    some = found.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*by))).where(F.col("place") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
