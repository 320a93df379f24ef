"""Removal of passages that occur in an earlier document, by a sparse suffix array.

A passage is any string of ``LENGTH`` bytes. In each such window the least hash of its
ANCHOR-byte substrings is its anchor, so equal windows have equal anchors at the same
place. Only suffixes that start at anchors are sorted, one in fourteen, and of these only
those whose anchor occurs in several documents:

1. Groups of documents send the hashes of their anchors to buckets, which return the
   ones that several documents have.
2. For these the groups send the text around the anchor, once for equal texts of a
   group; the later documents of the group are settled there.
3. Each bucket sorts the suffixes to the right of its anchors, and the reversed prefixes to the
   left, each as far as a window reaches, deep-shallow: multikey quicksort by eight-byte keys to a shallow depth, then a blind trie for
   each group that is still together. Common prefixes of neighbours give, for each place of
   the anchor in the window, the classes of equal windows and the least document of each.
4. The groups cut the windows of which an earlier document has the class.

Of an anchor that many groups have, the windows are sent one by one, to buckets by their bytes and a salt of the group. There they are judged in the same way,
and one of each class goes on to the bucket of its bytes, so that no bucket gets a row from each group. A document equal to an earlier one is settled
before, so a text that fills a third of the table takes part once.

Edge cases: null and empty texts have no bytes and lose none; texts of fewer than LENGTH
bytes lose none; of texts of any length all windows are judged, in pieces; rows with
equal ids are not earlier than each other; rows with a null id take no part and lose none; an empty
table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import materialise

LENGTH = 50
ANCHOR = 24
#: Bytes of text of one group of documents, and of one bucket's anchors.
GROUP_BYTES = 3_000_000
#: Longer texts are scanned in overlapping pieces.
PIECE_BYTES = 4_000_000
#: Groups that may have an anchor before its windows are dealt out one by one, and salts of these.
HOT_GROUPS, SALTS = 2_000, 1_000
#: Depth to which multikey quicksort goes.
SHALLOW = 16
_PLACES = LENGTH - ANCHOR + 1  # of the anchor in a window
_POS = 28
_U = np.uint64
_RIGHT = "gid bigint, kind string, docs binary, tags binary, a binary, b binary"
_SIDE = pa.schema([("gid", pa.int64()), ("kind", pa.string()), *((n, pa.binary()) for n in ("docs", "tags", "a", "b"))])


def _hashes(buf: np.ndarray) -> np.ndarray:
    """A hash of the ANCHOR bytes at each place of a buffer."""
    n = len(buf) - ANCHOR + 1
    words = np.ndarray((len(buf) - 7,), "<u8", buf.data, strides=(1,))
    h = words[:n] * _U(0x9E3779B97F4A7C15) + words[8 : n + 8] * _U(0xC2B2AE3D27D4EB4F) + words[16 : n + 16] * _U(0x165667B19E3779F9)
    h ^= h >> _U(29)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(32)
    return h


def anchors(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each run of windows with one anchor: its hash, place, first and last window start, and text number.

    The texts are buf[starts[i]:ends[i]]; windows lie within a text. Ties go to the leftmost.
    """
    empty = (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4)))
    long = np.flatnonzero(ends - starts >= LENGTH)
    if not len(long):
        return empty
    h = _hashes(buf)
    key = (h >> _U(_POS) << _U(_POS)) | np.arange(len(h), dtype=np.uint64)
    least, reach = key, 1
    while reach * 2 <= _PLACES:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < _PLACES:
        extra = _PLACES - reach
        least = np.minimum(least[:-extra], least[extra:])
    place = (least & _U((1 << _POS) - 1)).astype(np.int64)
    ok = np.zeros(len(place) + 1, np.int8)
    np.add.at(ok, starts[long], 1)
    np.add.at(ok, ends[long] - LENGTH + 1, -1)
    at = np.flatnonzero(np.cumsum(ok[:-1]))
    p = place[at]
    new = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (at[1:] != at[:-1] + 1)]))
    first, last = at[new], at[np.concatenate([new[1:], [len(at)]]) - 1]
    p = p[new]
    return h[p], p, first, last, np.searchsorted(starts, first, "right") - 1


class _Texts:
    """The documents of a group: bytes, ids and content tags; those that are settled have no pieces."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        self.ids = table.column("doc_id").to_numpy()
        self.tags = table.column("tag").to_numpy()
        self.texts = [x.as_buffer() if x.is_valid else b"" for c in table.column("text").cast(pa.large_string()).chunks for x in c]

    def pieces(self, skip: set) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Buffers with starts, ends, document numbers and offsets of pieces of documents."""
        held: list = []
        size = 0
        for i, t in enumerate(self.texts):
            if len(t) < LENGTH or (self.ids[i], self.tags[i]) in skip:
                continue
            for off in range(0, len(t) - LENGTH + 1, PIECE_BYTES):
                part = memoryview(t)[off : off + PIECE_BYTES + LENGTH - 1]
                held.append((i, off, part))
                size += len(part)
                if size >= PIECE_BYTES:
                    yield self._join(held)
                    held, size = [], 0
        if held:
            yield self._join(held)

    @staticmethod
    def _join(held: list):
        sizes = np.array([len(p) for _, _, p in held], np.int64)
        ends = np.cumsum(sizes)
        buf = np.frombuffer(b"".join(p for *_, p in held), np.uint8)
        return buf, ends - sizes, ends, np.array([i for i, *_ in held]), np.array([o for _, o, _ in held], np.int64)


def _blob(x) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _settled(side: pa.Table) -> set:
    out: set = set()
    for kind, d, t in zip(*(side.column(c).to_pylist() for c in ("kind", "docs", "tags")), strict=True):
        if kind == "equal":
            out.update(zip(np.frombuffer(d, np.int64).tolist(), np.frombuffer(t, np.int64).tolist(), strict=True))
    return out


def _send_hashes(buckets: int):
    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        texts, skip = _Texts(docs), _settled(side)
        hs, owners = [], []
        for buf, starts, ends, doc, _ in texts.pieces(skip):
            h, _, _, _, which = anchors(buf, starts, ends)
            hs.append(h)
            owners.append(texts.ids[doc[which]])
        rows: list = [[], [], [], []]
        if hs:
            gid = docs.column("gid")[0].as_py()
            h, owner = np.concatenate(hs), np.concatenate(owners)
            order = np.lexsort((owner, h))
            h, owner = h[order], owner[order]
            new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            last = np.concatenate([new[1:], [len(h)]]) - 1
            several, h = owner[new] != owner[last], h[new]
            bucket = (h % _U(buckets)).astype(np.int64)
            for b, at in _by(bucket):
                rows[0].append(b)
                rows[1].append(gid)
                rows[2].append(_blob(h[at]))
                rows[3].append(_blob(several[at].astype(np.uint8)))
        return pa.table({"bucket": pa.array(rows[0], pa.int64()), "gid": pa.array(rows[1], pa.int64()), "h": pa.array(rows[2], pa.binary()), "several": pa.array(rows[3], pa.binary())})

    return run


def _by(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value of ``key`` and where it stands, in the order given."""
    order = np.argsort(key, kind="stable")
    if len(order):
        sorted_key = key[order]
        cuts = np.flatnonzero(sorted_key[1:] != sorted_key[:-1]) + 1
        for part in np.split(order, cuts):
            yield int(key[part[0]]), part


def _answer(table: pa.Table) -> pa.Table:
    """Of one bucket: the anchors that several documents have, back to each group that sent them."""
    gids = table.column("gid").to_numpy()
    parts = [np.frombuffer(x, np.uint64) for x in table.column("h").to_pylist()]
    h = np.concatenate(parts)
    several = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("several").to_pylist()]).astype(bool)
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
    order = np.argsort(h, kind="stable")
    sorted_h = h[order]
    same = sorted_h[1:] == sorted_h[:-1]
    want = several[order]
    want[1:] |= same
    want[:-1] |= same
    chosen = order[want]
    run = np.cumsum(np.concatenate([[True], ~same])) - 1
    hot = (np.bincount(run)[run] > HOT_GROUPS)[want]
    out_gid, out_h, out_hot = [], [], []
    for o, at in _by(owner[chosen]):
        out_gid.append(int(gids[o]))
        out_h.append(_blob(h[chosen[at]]))
        out_hot.append(_blob(hot[at].astype(np.uint8)))
    none = [b""] * len(out_gid)
    return pa.table([pa.array(out_gid, pa.int64()), pa.array(["anchor"] * len(out_gid), pa.string()), pa.array(none, pa.binary()), pa.array(none, pa.binary()), pa.array(out_h, pa.binary()), pa.array(out_hot, pa.binary())], schema=_SIDE)


def _spans(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted and united spans of each (doc, tag)."""
    order = np.lexsort((start, tag, doc))
    doc, tag, start, end = doc[order], tag[order], start[order], end[order]
    if not len(doc):
        return doc, tag, start, end
    other = np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])])
    # the furthest end so far within a document: ends are raised by the document's number
    shift = np.cumsum(other) * (int(end.max()) + 2)
    far = np.maximum.accumulate(end + shift)
    new = np.flatnonzero(np.concatenate([[True], (start + shift)[1:] > far[:-1]]) | other)
    last = np.concatenate([new[1:], [len(doc)]]) - 1
    return doc[new], tag[new], start[new], far[last] - shift[last]


_SENT = ("bucket", "level", "gid", "docs", "tags", "a", "b", "h", "left", "size", "text")
_SENT_DDL = "bucket bigint, level int, gid bigint, docs binary, tags binary, a binary, b binary, h binary, left binary, size binary, text binary"
_SENT_SCHEMA = pa.schema([(n, pa.int64() if n in ("bucket", "gid") else pa.int32() if n == "level" else pa.binary()) for n in _SENT])
#: Levels of rows: judged at once; windows of a salt, of which some go on; windows of all salts; places to cut.
_PLAIN, _SALTED, _LAST, _SPANS = 0, 1, 2, 3


def _content_hash(window: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(window, digest_size=7).digest(), "little")


def _rows(level: int, gid: int, found: list[tuple], bucket_of) -> Iterator[tuple]:
    """Rows of contexts (h, left, text, place, doc, tag), a row for each bucket."""
    for b, at in _by(np.array([bucket_of(x) for x in found], np.int64)):
        part = [found[i] for i in at.tolist()]
        numbers = (_blob(np.array([x[k] for x in part], np.int64)) for k in (4, 5, 3))
        yield (b, level, gid, *numbers, b"", _blob(np.array([x[0] for x in part], np.uint64)), bytes(x[1] for x in part), bytes(len(x[2]) - LENGTH + 1 for x in part), b"".join(x[2] for x in part))


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SENT_SCHEMA)], schema=_SENT_SCHEMA)


def _send_texts(buckets: int):
    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        texts, skip = _Texts(docs), _settled(side)
        lists = [[np.frombuffer(x, kind) for k, x in zip(side.column("kind").to_pylist(), side.column(c).to_pylist(), strict=True) if k == "anchor"] for c, kind in (("a", np.uint64), ("b", np.uint8))]
        rows: list[tuple] = []
        if lists[0] and docs.num_rows:
            gid = docs.column("gid")[0].as_py()
            wanted, hot = (np.concatenate(x) for x in lists)
            order = np.argsort(wanted)
            wanted, hot = wanted[order], hot[order]
            own: dict[bytes, int] = {}
            found: list = []
            for buf, starts, ends, doc, off in texts.pieces(skip):
                h, p, first, last, which = anchors(buf, starts, ends)
                at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                hit = np.flatnonzero(wanted[at] == h)
                h, p, first, last, which, at = (x[hit] for x in (h, p, first, last, which, at))
                where = first - starts[which] + off[which]
                ids, tags = texts.ids[doc[which]], texts.tags[doc[which]]
                raw = buf.tobytes()
                for x in zip(h.tolist(), (p - first).tolist(), first.tolist(), (last + LENGTH).tolist(), where.tolist(), ids.tolist(), tags.tolist(), hot[at].tolist(), strict=True):
                    content = raw[x[2] : x[3]]
                    key = bytes((x[1],)) + content
                    least = own.get(key)
                    if least is None or x[5] < least:
                        own[key] = x[5]
                    found.append(((x[0], x[1], content, x[4], x[5], x[6]), key, x[7]))
            # all windows of a text that an earlier document of the group has go
            gone = [(x[4], x[5], x[3], x[3] + len(x[2])) for x, key, _ in found if own[key] < x[4]]
            if gone:
                rows.append((gid % buckets, _SPANS, gid, *map(_blob, _spans(*(np.array(x, np.int64) for x in zip(*gone, strict=True)))), b"", b"", b"", b""))
            rest = [(x, is_hot) for x, key, is_hot in found if own[key] == x[4]]
            rows += _rows(_PLAIN, gid, [x for x, is_hot in rest if not is_hot], lambda x: x[0] % buckets)
            windows = [(h, left - j, text[j : j + LENGTH], place + j, d, t) for (h, left, text, place, d, t), is_hot in rest if is_hot for j in range(len(text) - LENGTH + 1)]
            rows += _rows(_SALTED, gid, windows, lambda x: (_content_hash(x[2]) + gid % SALTS * 0x9E3779B1) % buckets)
        return _table(rows)

    return run


# -- deep-shallow sorting ----------------------------------------------------------------


class BlindTrie:
    """A trie of strings that keeps only branching depths; of equal strings it counts one."""

    def __init__(self, first: bytes):
        # a leaf is a string; an inner node is [depth, {byte: child}], byte -1 where the string ends
        self.root: object = first

    @staticmethod
    def _at(s: bytes, depth: int) -> int:
        return s[depth] if depth < len(s) else -1

    def add(self, s: bytes) -> None:
        node = self.root
        while isinstance(node, list):  # blindly, by branching bytes alone
            child = node[1].get(self._at(s, node[0]))
            node = child if child is not None else next(iter(node[1].values()))
        if node == s:
            return
        common, most = 0, min(len(node), len(s))
        while common < most and node[common] == s[common]:
            common += 1
        branch, other = self._at(s, common), self._at(node, common)
        holder, by, node = None, 0, self.root
        while isinstance(node, list) and node[0] < common:
            holder, by = node, self._at(s, node[0])
            node = node[1][by]
        if isinstance(node, list) and node[0] == common:
            node[1][branch] = s
            return
        fresh = [common, {branch: s, other: node}]
        if holder is None:
            self.root = fresh
        else:
            holder[1][by] = fresh

    def ordered(self) -> list[bytes]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
            else:
                out.append(node)
        return out


def deep_shallow(group: np.ndarray, rows: np.ndarray, shallow: int = SHALLOW) -> np.ndarray:
    """The order of byte rows, zero-filled, within groups: eight-byte keys to ``shallow``, then blind tries."""
    keys = [rows[:, d : d + 8].copy().view(">u8").ravel().astype(np.uint64) for d in range(0, min(shallow, rows.shape[1] // 8 * 8), 8)]
    order = _multikey(np.argsort(group, kind="quicksort"), group, keys)
    together = np.ones(len(order), bool)
    together[0] = False
    for k in (group, *keys):
        together[1:] &= k[order][1:] == k[order][:-1]
    depth = 8 * len(keys)
    tails = rows[order, depth:]
    differ = np.zeros(len(order), bool)
    differ[1:] = together[1:] & (tails[1:] != tails[:-1]).any(axis=1)
    starts = np.flatnonzero(~together)
    number = np.cumsum(~together) - 1
    for g in np.unique(number[differ]):  # groups that aren't of one string
        a = starts[g]
        b = starts[g + 1] if g + 1 < len(starts) else len(order)
        strings = [t.tobytes() for t in tails[a:b]]
        trie = BlindTrie(strings[0])
        for s in set(strings):
            trie.add(s)
        rank = {s: i for i, s in enumerate(trie.ordered())}
        order[a:b] = order[a:b][np.argsort([rank[s] for s in strings], kind="stable")]
    return order


def _multikey(order: np.ndarray, group: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    """Multikey quicksort of rows that are ordered by group, all runs of equal rows at once.

    A run is parted about a pivot of its own into rows with a lesser, the same and a greater key; only
    the middle part goes on to the next key, and runs of one row are done.
    """
    table, order = np.stack(keys), order.copy()
    label = group[order]
    starts = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]])) if len(order) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(order)))
    depths = np.zeros(len(starts), np.int64)
    while True:
        go = (sizes > 1) & (depths < len(keys))
        starts, sizes, depths = starts[go], sizes[go], depths[go]
        if not len(starts):
            return order
        run = np.repeat(np.arange(len(starts)), sizes)
        at = np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[run]
        key = table[depths[run], order[at]]
        ends = [table[depths, order[p]] for p in (starts, starts + sizes // 2, starts + sizes - 1)]
        pivot = np.sort(np.stack(ends), axis=0)[1][run]  # the median of three
        part = run * 3 + (key >= pivot) + (key > pivot)
        fresh = np.argsort(part, kind="stable")
        order[at] = order[at][fresh]
        part = part[fresh]
        new = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        sizes, starts, depths = np.diff(np.append(new, len(part))), at[new], depths[part[new] // 3] + (part[new] % 3 == 1)


def _common(group: np.ndarray, rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row with the one before it in the order; -1 where a group begins."""
    x, g = rows[order], group[order]
    lcp = np.full(len(order), -1)
    unequal = x[1:] != x[:-1]
    lcp[1:] = np.where(unequal.any(axis=1), unequal.argmax(axis=1), rows.shape[1])
    lcp[1:][g[1:] != g[:-1]] = -1
    return lcp


def _matches(h, doc, left, size, text) -> tuple[np.ndarray, np.ndarray]:
    """Row number and window start (from the row's text start) of all windows that an earlier document has."""
    n = len(h)
    begin = np.cumsum(size.astype(np.int64) + LENGTH - 1) - (size + LENGTH - 1)
    flat = np.frombuffer(text, np.uint8)
    padded = np.concatenate([np.zeros(LENGTH, np.uint8), flat, np.zeros(LENGTH, np.uint8)])
    at = begin + left + LENGTH  # the anchor
    wide = (LENGTH - ANCHOR + 7) // 8 * 8
    cols = np.arange(wide)
    right_len = size.astype(np.int64) + LENGTH - 1 - left - ANCHOR
    right = np.where(cols < right_len[:, None], padded[np.minimum(at[:, None] + ANCHOR + cols, len(padded) - 1)], 0).astype(np.uint8)
    back = np.where(cols < left[:, None], padded[np.maximum(at[:, None] - 1 - cols, 0)], 0).astype(np.uint8)
    _, group = np.unique(h, return_inverse=True)
    classes = []
    for rows in (right, back):
        order = deep_shallow(group, rows)
        classes.append((order, _common(group, rows, order)))
    out_row, out_at = [], []
    inverse = np.empty(n, np.int64)
    for o in range(_PLACES):  # bytes of the window to the left of the anchor
        sel = np.flatnonzero((left >= o) & (left - o < size))
        if not len(sel):
            continue
        ids = []
        for (order, lcp), depth in zip(classes, (LENGTH - ANCHOR - o, o), strict=True):
            inverse[order] = np.cumsum((lcp < depth))
            ids.append(inverse[sel])
        key = ids[0] * (n + 1) + ids[1]
        by = np.lexsort((doc[sel], key))
        k = key[by]
        new = np.concatenate([[True], k[1:] != k[:-1]])
        least = doc[sel][by][new][np.cumsum(new) - 1]
        late = sel[by[doc[sel][by] > least]]
        out_row.append(late)
        out_at.append(left[late] - o)
    return (np.concatenate(out_row), np.concatenate(out_at)) if out_row else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _judge(buckets: int):
    """Of one bucket and level: places to cut, and of salted windows those that go on."""

    def run(table: pa.Table) -> pa.Table:
        level, rows = table.column("level")[0].as_py(), []
        if level == _SPANS:
            return table.select(_SENT)
        cols = {n: table.column(n).to_pylist() for n in _SENT if n not in ("bucket", "level")}
        join = lambda n, kind: np.frombuffer(b"".join(cols[n]), kind)
        h, doc, tag, where = join("h", np.uint64), join("docs", np.int64), join("tags", np.int64), join("a", np.int64)
        left, size, text = join("left", np.uint8).astype(np.int64), join("size", np.uint8).astype(np.int64), b"".join(cols["text"])
        gid = np.repeat(cols["gid"], [len(x) for x in cols["left"]])
        row, at = _matches(h, doc, left, size, text)
        start = where[row] + at
        for g, part in _by(gid[row]):
            r = row[part]
            rows.append((g % buckets, _SPANS, g, *map(_blob, _spans(doc[r], tag[r], start[part], start[part] + LENGTH)), b"", b"", b"", b""))
        if level == _SALTED:
            stays = np.ones(len(h), bool)
            stays[row] = False
            for g, part in _by(np.where(stays, gid, -1)):
                if g >= 0:
                    found = [(int(h[i]), int(left[i]), text[i * LENGTH : (i + 1) * LENGTH], int(where[i]), int(doc[i]), int(tag[i])) for i in part.tolist()]
                    rows += _rows(_LAST, g, found, lambda x: _content_hash(x[2]) % buckets)
        return _table(rows)

    return run


def _as_side(df: DataFrame) -> DataFrame:
    return df.where(F.col("level") == _SPANS).select("gid", F.lit("span").alias("kind"), "docs", "tags", "a", "b")


def _cut(docs: pa.Table, side: pa.Table) -> pa.Table:
    texts, skip = _Texts(docs), _settled(side)
    parts = [[np.frombuffer(side.column(c)[i].as_buffer(), np.int64) for c in ("docs", "tags", "a", "b")] for i, k in enumerate(side.column("kind").to_pylist()) if k == "span"]
    spans: dict[tuple, list[tuple[int, int]]] = {}
    if parts:
        for d, t, a, b in zip(*(x.tolist() for x in _spans(*(np.concatenate(x) for x in zip(*parts, strict=True)))), strict=True):
            spans.setdefault((d, t), []).append((a, b))
    out: list[tuple] = []
    for i, text in enumerate(texts.texts):
        key = (texts.ids[i], texts.tags[i])
        raw = bytes(text)
        gone = [(0, len(raw))] if key in skip else spans.get(key, [])
        at, kept = 0, []
        for a, b in gone:
            kept.append(raw[at:a])
            at = b
        kept = b"".join([*kept, raw[at:]])
        out.append((int(key[0]), len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in gone]))
    kinds = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
    return pa.table([pa.array([r[i] for r in out], f.type) for i, f in enumerate(kinds)], schema=kinds)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of each document row.

    ``spans`` are the removed runs as byte ranges of the text, end excluded.
    """
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    groups = max(8, -(-int(size) // GROUP_BYTES))
    # groups of a bounded size; a longer text is a group's one
    known = own.where("doc_id is not null").select(F.pmod(F.xxhash64("doc_id"), F.lit(groups)).alias("gid"), "doc_id", F.xxhash64("text").alias("tag"), "text")
    digests = own.where("doc_id is not null").where(F.octet_length("text") >= LENGTH).select("doc_id", F.xxhash64("text").alias("tag"), F.xxhash64(F.lit(7), "text").alias("tag2"))
    # written, so that Spark can split the copies of a frequent text in the join below
    first = digests.groupBy("tag", "tag2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    first = materialise(first.select(F.col("tag").alias("t1"), F.col("tag2").alias("t2"), "least"), "repeats-first")
    equal = digests.join(first, (F.col("tag") == F.col("t1")) & (F.col("tag2") == F.col("t2"))).where(F.col("doc_id") > F.col("least"))
    packed = F.array_join(F.transform(F.collect_list(F.struct("doc_id", "tag")), lambda x: F.concat(_big_endian(x["doc_id"]), _big_endian(x["tag"]))), "")
    equal = equal.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(groups)).alias("gid")).agg(packed.alias("hex"))
    equal = materialise(equal.mapInArrow(_equal_side, _RIGHT), "repeats-equal")

    def both(side: DataFrame):
        return known.groupBy("gid").cogroup(side.groupBy("gid"))

    sent = both(equal).applyInArrow(_send_hashes(groups), "bucket bigint, gid bigint, h binary, several binary")
    answers = sent.groupBy("bucket").applyInArrow(_answer, _RIGHT)
    texts = both(equal.unionByName(answers)).applyInArrow(_send_texts(groups), _SENT_DDL)
    # what a group has settled is passed by; each bucket's other rows are judged, once more where they come from salts
    judge = lambda df: df.groupBy("bucket", "level").applyInArrow(_judge(groups), _SENT_DDL)
    found = materialise(judge(texts), "repeats-found")
    last = judge(found.where(F.col("level") == _LAST))
    spans = _as_side(found).unionByName(_as_side(last))
    out = both(equal.unionByName(spans)).applyInArrow(_cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>")
    rest = own.where("doc_id is null").select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("n_removed"), F.lit(0).cast("bigint").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))
    return out.unionByName(rest)


def _big_endian(x):
    """16 hex digits of a long."""
    return F.lpad(F.hex(x), 16, "0")


def _equal_side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, tags = [], []
        for x in batch.column(1).to_pylist():
            pairs = np.frombuffer(bytes.fromhex(x), ">i8").astype(np.int64).reshape(-1, 2)
            docs.append(_blob(pairs[:, 0]))
            tags.append(_blob(pairs[:, 1]))
        n = batch.num_rows
        yield pa.record_batch([batch.column(0), pa.array(["equal"] * n, pa.string()), pa.array(docs, pa.binary()), pa.array(tags, pa.binary()), pa.array([b""] * n, pa.binary()), pa.array([b""] * n, pa.binary())], schema=_SIDE)
