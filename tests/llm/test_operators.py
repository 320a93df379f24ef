import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from lodestar.llm import ann, bpe, decontam, line_dedup, minhash, pii, quality, suffix_dedup, token_counts, warc

RANKS = P.path("byte_bpe_50k.tiktoken")
ODD = [(1, None), (2, ""), (3, " \n\n "), (4, "x" * 5000), (5, "a b c"), (5, "a b c"), (None, "none of these"), (7, "ünïcödé 日本 🙂 " * 30)]


def frame(spark, rows, extra=True):
    # a clashing extra column must not matter
    if extra:
        return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, key int")
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_bpe_equals_tiktoken_and_round_trips(spark):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    got = sorted(map(tuple, bpe.token_digests(frame(spark, ODD), RANKS, P.PATTERN).collect()), key=repr)
    want = []
    for d, t in ODD:
        ids = enc.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), True))
    assert got == sorted(want, key=repr)
    ids = bpe.encode(frame(spark, ODD), RANKS, P.PATTERN)
    assert sorted(bytes(r.bytes).decode() for r in bpe.decode(ids, RANKS, P.PATTERN).collect()) == sorted(t or "" for _, t in ODD)
    assert bpe.token_digests(frame(spark, []), RANKS, P.PATTERN).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        fresh = [i]
        for j, y in enumerate(b, 1):
            fresh.append(min(row[j] + 1, fresh[-1] + 1, row[j - 1] + (x != y)))
        row = fresh
    return row[-1]


def changed(rng, text, n):
    s = list(text)
    for _ in range(n):
        i = rng.randrange(len(s))
        s[i : i + 1] = rng.choice([[], ["z"], [s[i], "z"]])
    return "".join(s)


def line_report(docs):
    """Rows of ``report`` and texts after dedup, by all pairs of different lines."""
    first, rows = {}, {}
    for d, t in sorted((d, t) for d, t in docs if t is not None):
        for i, x in enumerate(t.split("\n")):
            rows[d, i] = x
            if len(x) >= line_dedup.MIN_CHARS or x.strip():
                first[x] = min(first.get(x, (d, i)), (d, i))
    places = sorted((p, x) for x, p in first.items())
    least = {p: p for p, _ in places}

    def root(p):
        while least[p] != p:
            p = least[p]
        return p

    for k, (p, a) in enumerate(places):
        for q, b in places[k + 1 :]:
            if min(len(a), len(b)) >= line_dedup.MIN_CHARS and abs(len(a) - len(b)) <= 2 and edits(a, b) <= 2:
                p0, q0 = sorted((root(p), root(q)))
                least[q0] = p0
    size = {}
    for p, _ in places:
        size[root(p)] = size.get(root(p), 0) + 1
    out, texts = {}, {}
    for d, t in docs:
        n_exact = n_near = n_links = 0
        members, kept = [], []
        for i, x in enumerate((t or "").split("\n")):
            p = first.get(x)
            if p is not None and (p != (d, i) or size[root(p)] > 1):
                members.append((i, *root(p)))
                n_links += size[root(p)] - 1
                n_exact += p != (d, i)
                n_near += p == (d, i) != root(p)
            if p is None or root(p) == (d, i):
                kept.append(x)
        texts[d] = t and "\n".join(kept)
        out[d] = ((t or "").count("\n") + 1 if t else 0, n_exact, n_near, n_links, members or None, hashlib.sha256(texts[d].encode()).hexdigest() if t is not None else None)
    return out, texts


def got_report(spark, docs):
    rows = line_dedup.report(frame(spark, docs)).collect()
    return {r.doc_id: (*tuple(r)[1:5], None if r.members is None else [tuple(m) for m in r.members], r.kept_sha256) for r in rows}


def test_line_report_against_all_pairs(spark, monkeypatch):
    rng = random.Random(13)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(9, 60))) for _ in range(14)]
    docs = [(d * 7 % 101, "\n".join(rng.choice(["", " ", "ab", *base, *(changed(rng, rng.choice(base), rng.randint(1, 4)) for _ in range(12))]) for _ in range(rng.randint(1, 6)))) for d in range(60)] + [(700, None), (701, "")]
    want, texts = line_report(docs)
    assert any(x[2] for x in want.values()) and any(x[1] for x in want.values())
    for crowd in (line_dedup.CROWD, 2):  # hubs change the plan, not the rows
        monkeypatch.setattr(line_dedup, "CROWD", crowd)
        assert got_report(spark, docs) == want
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, docs)).collect()} == texts


def test_lines_around_a_hub_give_a_few_links_each(spark):
    rng = random.Random(17)
    base = "".join(rng.choice("abcdefghij ") for _ in range(60))
    links = {}
    for n in (60, 180):
        docs = [(d, base[: (k := rng.randrange(60))] + rng.choice("klmnopqrstuvwxyz") + base[k + 1 :] + "\n") for d in range(n)]
        _, found = line_dedup.duplicate_lines(frame(spark, docs, False))
        links[n] = found.count() / n
        if n == 60:
            assert got_report(spark, docs) == line_report(docs)[0]
    assert links[180] < 1.5 * links[60] and links[180] < 12


def test_line_links_are_all_pairs_within_two_edits(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(30, 60))) for _ in range(12)]
    docs = [(d, "\n".join(changed(rng, rng.choice(base), rng.randint(0, 3)) for _ in range(rng.randint(0, 4)))) for d in range(30)]
    _, links = line_dedup.duplicate_lines(frame(spark, docs, False))
    first = {}
    for d, t in docs:
        for i, line in enumerate(t.split("\n")):
            if len(line) >= line_dedup.MIN_CHARS:
                first.setdefault(line, (d, i))
    places = sorted((p, x) for x, p in first.items())
    want = {(*p, *q, e) for k, (p, a) in enumerate(places) for q, b in places[k + 1 :] if (e := edits(a, b)) <= 2}
    assert {tuple(r) for r in links.collect()} == want and want


def test_helper_columns_never_clash(spark):
    names = ("of_doc", "gone_lines", "__doc", "__lines", "again", "line", "hub", "key", "class_id", "of_gone")
    row = [str(i) for i in range(len(names))]
    docs = spark.createDataFrame([(1, "the same line of text", *row), (2, "the same line of text", *row)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and {tuple(r) for r in out.collect()} == {(1, "the same line of text", *row), (2, "", *row)}
    assert [tuple(r) for r in minhash.keep_one(docs).collect()] == [(1, "the same line of text", *row)]


def test_line_dedup_keeps_odd_rows_and_drops_later_lines(spark):
    line = "this line is long enough to be a duplicate of itself"
    rows = [*ODD, (20, f"{line}\nown line of twenty, long enough"), (21, f"{line}\nshort\n"), (22, line.replace("long", "lung"))]
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert out[1] is None and out[2] == "" and out[None] == "none of these" and out[20].startswith(line)
    assert out[21] == "short\n" and out[22] == ""
    assert line_dedup.report(frame(spark, [])).count() == 0


def test_pseudonyms_are_invertible_linked_and_valid(spark):
    text = "card 4111 1111 1111 1111, on 2024-02-29, call +1 (369) 555-1339 or 10.0.0.1, a.b9@example.com, 123-45-6789, no 4111 1111 1111 1112"
    fresh, found = pii.mask_text(text, b"k")
    assert [k for k, *_ in found] == ["card", "date", "phone", "ip", "email", "ssn"]  # all but the invalid card
    assert pii.mask_text(fresh, b"k", True)[0] == text and "4111 1111 1111 1112" in fresh
    assert len({pii.permute(i, 1000, b"k", "t") for i in range(1000)}) == 1000
    digits = "".join(c for c in fresh[5:24] if c.isdigit())
    assert pii.luhn_digit(digits[:-1]) == int(digits[-1])
    assert pii.report(frame(spark, ODD), b"k").count() == len(ODD)


def test_pseudonym_report_against_planted_values(spark):
    rng = random.Random(31)
    values = [("card", "4111 1111 1111 1111"), ("card", "5500005555555559"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("ssn", "123-45-6789"), ("phone", "(369) 555-1339"), ("phone", "+44 207 946 0958"), ("ip", "10.0.200.7"), ("date", "2024-02-29"), ("date", "31/12/2020"), ("email", "jane.doe9")]
    docs, want = [(1, None), (2, ""), (3, "4111 1111 1111 1112 and 2023-02-29 and 300.1.1.1 are none")], {1: ([], None), 2: ([], ""), 3: ([], None)}
    for d in range(4, 30):
        text, spans = "", []
        for _ in range(rng.randint(0, 5) if d < 29 else 3000):
            text += " ".join(rng.choice(["some", "plain", "wörds"]) for _ in range(rng.randint(1, 4))) + ", "
            kind, value = rng.choice(values)
            spans.append((kind, len(text), len(text) + len(value)))
            text += value + ("@example.com" if kind == "email" else "") + "; "
        docs.append((d, text))
        want[d] = (spans, None)
    rows = {r.doc_id: r for r in pii.report(frame(spark, docs + [docs[5]]), b"k").collect()}
    assert rows.keys() == want.keys()
    for d, text in docs:
        fresh, at = "", 0
        for kind, a, b in want[d][0]:
            fresh, at = fresh + text[at:a] + pii.pseudonym(kind, text[a:b], b"k"), b
        fresh += (text or "")[at:]
        r = rows[d]
        assert [tuple(x) for x in r.spans] == want[d][0] and r.n_found == len(want[d][0])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in want[d][0]) for k in pii.KINDS]
        assert r.masked_sha256 == hashlib.sha256(fresh.encode()).hexdigest()
    masked = {r.doc_id: r.text for r in pii.mask_documents(frame(spark, docs), b"k").collect()}
    assert masked[1] is None and masked[2] == "" and masked[3] == docs[2][1]
    assert pii.report(frame(spark, []), b"k").count() == 0


def test_token_totals_equal_a_recount_and_batches_count_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b", "en", "s"), (2, None, None, "s"), (3, "c d e", "en", "s")], "doc_id long, text string, lang string, source string")
    count = lambda df: token_counts.count_tokens(df, {"v": RANKS}, P.PATTERN)
    r = token_counts.Rollup(spark, f"file://{tmp_path}/r")
    assert r.commit("one", token_counts.changes(None, count(docs)))
    revised = docs.where("doc_id = 1").withColumn("text", docs.lang)
    change = token_counts.changes(count(docs.where("doc_id = 1")), count(revised))
    assert r.commit("two", change) and not r.commit("two", change)
    assert r.compact() == 1 and not r.commit("two", change) and r.compact() == 2
    r.commit("three", token_counts.changes(count(docs.where("doc_id = 3")), None))
    r.commit("none", token_counts.changes(None, count(docs.limit(0))))
    assert r.totals().count() == 2 and token_counts.Rollup(spark, f"file://{tmp_path}/empty").totals().count() == 0
    assert {(x.lang, x.docs, x.tokens, x.bytes) for x in r.totals().collect()} == {("en", 1, 1, 2), (None, 1, 0, 0)}


def removed(docs):
    first = {}
    for d, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(first.get(b[i : i + 50], d), d)
    out = []
    for d, t in docs:
        b = (t or "").encode()
        m = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                m[i : i + 50] = b"\1" * 50
        out.append((d, len(b), sum(m), sum(m[i] and not (i and m[i - 1]) for i in range(len(m))), hashlib.sha256(bytes(x for x, y in zip(b, m) if not y)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("hot", "salts"), [(suffix_dedup.HOT_GROUPS, suffix_dedup.SALTS), (1, 2)])
def test_repeats_against_brute_force(spark, monkeypatch, hot, salts):
    monkeypatch.setattr(suffix_dedup, "HOT_GROUPS", hot)
    monkeypatch.setattr(suffix_dedup, "SALTS", salts)
    rng = random.Random(5)
    pool = ["".join(rng.choice("ab é") for _ in range(rng.randint(10, 200))) for _ in range(8)]
    docs = [(d * 3 % 61, "".join(rng.choice(pool)[rng.randint(0, 9) : rng.randint(10, 200)] for _ in range(rng.randint(0, 6)))) for d in range(60)]
    docs += [(500, docs[3][1]), (501, docs[3][1]), (502, "x" * 300), (503, "x" * 120), (504, ""), (505, None), (506, "ab" * 100), (507, "ba" * 100), (504, "")]
    assert sorted(tuple(r)[:5] for r in suffix_dedup.remove_repeats(frame(spark, docs)).collect()) == removed(docs)
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_deep_shallow_sorts_within_groups():
    rng = np.random.default_rng(3)
    for n, letters in ((1, 2), (400, 2), (3000, 3), (500, 1)):
        rows = rng.integers(0, letters, (n, 32)).astype(np.uint8)
        rows[: n // 2, :20] = rows[0, :20]  # long common prefixes, beyond the shallow depth
        group = rng.integers(0, 7, n)
        order = suffix_dedup.deep_shallow(group, rows)
        assert sorted(order.tolist()) == list(range(n))
        got = [(int(group[i]), rows[i].tobytes()) for i in order]
        assert got == sorted(got)


def test_blind_trie_sorts():
    rng = random.Random(1)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 9))).encode() for _ in range(300)]
    trie = suffix_dedup.BlindTrie(strings[0])
    for s in strings:
        trie.add(s)
    assert trie.ordered() == sorted(set(strings))


def test_quality_learns_and_holds_out(spark):
    docs = [(i, ("good plain words here " if i % 2 else "JUNK!! MORE!! ") * 5) for i in range(60)] + ODD
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    df = frame(spark, docs)
    out = quality.scores(df, quality.train(df, labels)).collect()
    assert len(out) == len(docs) and all(0 <= r.score <= 1 for r in out)
    assert all(r.predicted == r.doc_id % 2 for r in out if r.doc_id is not None and r.doc_id > 7)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out if r.doc_id is not None)
    assert quality.scores(df, quality.train(df, labels.limit(0))).first().score == 0.5


def test_ftrl_updates_against_plain_python():
    texts = ["good plain words here", "JUNK!! MORE!! junk", "good plain JUNK!!", "", "words words words"] * 6
    labels = [1, 0, 1, 0, 1] * 6
    rows = [quality.features(t) for t in texts]
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return (math.copysign(quality.L1, z[i]) - z[i]) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for (at, x), y in zip(rows, labels, strict=True):
            w = {i: weight(i) for i in at.tolist()}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in zip(at.tolist(), x, strict=True))))
            for i, v in zip(at.tolist(), x.tolist(), strict=True):
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * w[i]
                n[i] += g * g
    got = quality.ftrl(rows, labels)
    assert np.allclose(got[sorted(z)], [weight(i) for i in sorted(z)]) and np.count_nonzero(got) == sum(weight(i) != 0 for i in z)


@pytest.mark.parametrize("blocks", [(100, 3), (37, 1000)])
def test_nearest_over_many_blocks(spark, monkeypatch, blocks):
    monkeypatch.setattr(ann, "BLOCK_VECTORS", blocks[0])
    monkeypatch.setattr(ann, "BLOCK_QUERIES", blocks[1])
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 16))
    x[7], x[8], x[9] = x[100], x[100] * 4, x[100]  # ties go to the smaller id
    x[200] *= 1e200
    x[250] *= 1e-200
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(450, x[450].tolist())]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 50).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    u = x / np.abs(x).max(axis=1)[:, None]
    u /= np.linalg.norm(u, axis=1)[:, None]
    hits = sum(len({v for v, _ in got[q]} & set([c for c in np.lexsort((np.arange(500), -(u @ u[q]))) if c != q][:5])) for q in range(0, 500, 50))
    assert hits >= 0.9 * 50 and all(len(v) == 5 for v in got.values()) and [v for v, _ in got[100]][:3] == [7, 8, 9]
    for q, found in got.items():
        assert all(abs(s - u[v] @ u[q]) < 1e-12 for v, s in found) and [s for _, s in found] == sorted((s for _, s in found), reverse=True)


def test_nearest_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1050, [0.0] * 16), (1100, [float("nan")] * 16), (1150, [1.0]), (None, [1.0] * 16)]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 50).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == set(range(0, 400, 50))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hits = sum(len(set(got[q]) & set([c for c in np.argsort(-(u @ u[q])) if c != q][:5])) for q in got)
    assert hits / (5 * len(got)) >= 0.9
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>"), 50).count() == 0


def test_multi_index_finds_all_codes_within_the_radius():
    codes = np.random.default_rng(1).integers(0, 256, (500, 4), dtype=np.uint8)
    index = ann.MultiIndex(codes)
    for radius in (0, 3, 7, 11, 32):
        apart = np.unpackbits(codes ^ codes[7], axis=1).sum(axis=1)
        assert index.within(codes[7], radius).tolist() == np.flatnonzero(apart <= radius).tolist()


@pytest.mark.parametrize("limit", [decontam.MAX_PATTERN_BYTES, 300])
def test_contamination_against_brute_force(spark, limit):
    rng = random.Random(4)
    words = lambda n: " ".join(rng.choice(["ab", "Cd", "é", "x1"]) for _ in range(n))
    items = [(i, words(rng.randint(1, 14))) for i in range(2, 14)] + [(1, None), (20, "?!")]
    docs = [(i, words(rng.randint(0, 60)).replace(" ", ", ")) for i in range(10, 40)] + ODD
    got = decontam.contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), limit=limit).collect()
    want = []
    for d, t in docs:
        w = decontam.words_of(t)
        hit, found = set(), set()
        for item, text in items:
            p = decontam.words_of(text)
            for k in range(max(1, len(p) - 9) if p else 0):
                g = p[k : k + 10]
                for i in range(len(w) - len(g) + 1):
                    if w[i : i + len(g)] == g:
                        hit.update(range(i, i + len(g)))
                        found.add(str(item))
        want.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted(want, key=repr)
    texts = dict(docs)
    assert all(s.start < s.end <= len(texts[r.doc_id]) for r in got for s in r.spans)


def near_classes(docs):
    """Least id of each document's class, by weighted similarity of all pairs."""
    bags = {}
    for d, t in docs:
        if d is not None:
            bags.setdefault(d, []).append(collections.Counter(zip(*(w[k:] for k in range(5)), strict=False) if len(w := minhash.words_of(t)) > 5 else [tuple(w)] if w else []))

    def alike(x, y):
        both = sum((x & y).values())
        return both and both >= 0.8 * sum((x | y).values())

    least = {d: d for d in bags}
    near = [(a, b) for a in bags for b in bags if a < b and any(alike(x, y) for x in bags[a] for y in bags[b])]
    for _ in bags:
        for a, b in near:
            least[a] = least[b] = min(least[a], least[b])
    return least


def test_hits_of_several_shards_add_up(spark):
    items = spark.createDataFrame([(j, " ".join(f"i{j}w{n}" for n in range(4))) for j in range(8)], "item_id long, text string")
    docs = frame(spark, [(1, " ".join(f"i{j}w{n}" for j in range(8) for n in range(4)) + " rest" * 8), (2, " ".join(f"i0w{n}" for n in range(4)) + " rest" * 36), (2, None), (None, "")])
    for limit in (decontam.MAX_PATTERN_BYTES, 60):
        assert [tuple(r)[1:4] for r in decontam.contamination(docs, items, limit=limit).where("doc_id = 1").collect()] == [(40, 32, 8)]
        kept = decontam.decontaminate(docs, items, most=0.5, limit=limit)
        assert kept.columns == docs.columns and sorted((tuple(r)[:2] for r in kept.collect()), key=repr) == sorted([(2, " ".join(f"i0w{n}" for n in range(4)) + " rest" * 36), (2, None), (None, "")], key=repr)


@pytest.mark.parametrize(("small", "block"), [(minhash.SMALL_BUCKET, minhash.BLOCK), (2, 7)])
def test_minhash_classes_equal_exact_components(spark, monkeypatch, small, block):
    monkeypatch.setattr(minhash, "SMALL_BUCKET", small)
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(500)]
    base = [[rng.choice(vocabulary) for _ in range(120)] for _ in range(6)]
    base[5] = base[5][:30] * 4  # repeated passages: weights count
    docs = []
    for d in range(150):
        w = list(base[d % 6])
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        docs.append((d + 10, " ".join(w)))
    docs += [(400 + k, " ".join(base[5][:30] * k)) for k in range(1, 8)] + [(5, docs[0][1]), (5, docs[1][1]), (6, "one two three four five six"), (6, docs[2][1] + " end"), (6, "six five four three two one"), *ODD]
    least = near_classes(docs)
    assert {r.doc_id: r.class_id for r in minhash.classes(frame(spark, docs)).collect()} == least
    kept = {r.doc_id for r in minhash.keep_one(frame(spark, docs)).collect()}
    assert kept == {d for d in least if least[d] == d} | {None}


def test_large_clusters_give_few_pairs(spark, monkeypatch):
    rng = random.Random(21)
    vocabulary = [f"w{i}" for i in range(500)]
    base, seen = [rng.choice(vocabulary) for _ in range(300)], []
    verify = minhash._verify
    monkeypatch.setattr(minhash, "_verify", lambda pairs, sets: seen.append(pairs.count()) or verify(pairs, sets))
    counts = {}
    for n in (60, 180):
        docs = []
        for d in range(n):
            w = list(base)
            w[rng.randrange(300)] = "x"
            w[rng.randrange(300)] = f"y{d}"
            docs.append((d, " ".join(w)))
        seen.clear()
        assert {r.class_id for r in minhash.classes(frame(spark, docs)).collect()} == {0}
        counts[n] = sum(seen) / n
    assert counts[180] < 1.5 * counts[60] and counts[180] < 8
    assert minhash.classes(frame(spark, [])).count() == 0


def test_agreement_cut_loses_less_than_the_bands():
    lost = sum(math.comb(minhash.K, k) * 0.8**k * 0.2 ** (minhash.K - k) for k in range(minhash.LEAST_AGREEMENT))
    assert lost < (1 - 0.8**minhash.ROWS) ** minhash.BANDS / 10


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    wa, wb = rng.choice([0.5, 1, 2, 3.5], 300), rng.choice([0.5, 1, 2, 3.5], 300)
    a, b = minhash.signatures([base, base], [wa, wb], 1024)
    assert abs((a == b).mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()) < 0.06


def test_warc_round_trip_and_revisits(spark):
    big = "é" * 600 + "WARC/1.1\r\n\r\n"
    rows = [(1, "http://a b/", big), (2, "u", big), (3, None, "small"), (4, "u", "small"), (5, "u", None), (6, "u", big), (None, "u", big), (6, "u", big), (1, "other", big), (7, "u", "x" * 1000), (7, "u", "y" * 1000), (3, "u", "y" * 1000)]
    got = sorted(map(tuple, warc.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()), key=repr)
    want = []
    for k, _, h in rows:
        raw = (h or "").encode()
        first = max((x for x, _, y in rows if x is not None and y == h), default=None)
        late = k is not None and k < first and len(raw) >= 1000
        want.append((k, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if late else "response", first if late else None))
    assert got == sorted(want, key=repr)
    assert warc.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    with pytest.raises(ValueError):
        list(warc.parse_arc(warc.arc_header(1, "x", "2026") + b"http://x 0 2026 text/html 99\nshort"))


def test_counts_of_all_versions_from_one_split(spark):
    other = P.path("byte_bpe_multi_50k.tiktoken")
    texts = [None, "", "a", "déjà vu, 日本 don't  stop\n\n 12345", "x" * 5000, "same", "same"]
    docs = spark.createDataFrame([(i, t, "s", None, "n") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string, tokenizer string")
    got = token_counts.count_tokens(docs, {"a": RANKS, "b": other}, P.PATTERN).collect()
    want = set()
    for name, path in (("a", RANKS), ("b", other)):
        enc = tiktoken.Encoding(name, pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
        want |= {(i, "s", None, name, len(enc.encode_ordinary(t or "")), len((t or "").encode())) for i, t in enumerate(texts)}
    assert {tuple(r) for r in got} == want and len(got) == 2 * len(texts)


def test_windows_of_one_shard_are_never_scanned_for_another(spark):
    # many shards over many partitions, and benchmarks one after another, in the same Python workers
    words = lambda k, j: " ".join(f"b{k}i{j}w{n}" for n in range(10))
    for k in range(2):
        items = spark.createDataFrame([(j, words(k, j)) for j in range(40)], "item_id long, text string")
        docs = frame(spark, [(j, f"start {words(k, j)} end") for j in range(40)] + [(100 + j, words(k + 1, j)) for j in range(40)]).repartition(12)
        for limit in (decontam.MAX_PATTERN_BYTES, 1500):
            got = {r.doc_id: (r.n_hit, r.n_items) for r in decontam.contamination(docs, items, limit=limit).collect()}
            assert got == {j: (10, 1) for j in range(40)} | {100 + j: (0, 0) for j in range(40)}
            assert {r.doc_id for r in decontam.decontaminate(docs, items, limit=limit).collect()} == {100 + j for j in range(40)}


def test_equal_lines_of_any_length_go_and_near_ones_from_nine_characters(spark):
    docs = [(1, "}\n\nAll rights reserved.\nabcdefghi\nabcd"), (2, "}\n\nAll rights reserved.\nabcdefgxi\nabce"), (3, "  \n}\nAll right reserved.\nabcdefghij\nabcd"), (4, "  \n}")]
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, docs)).collect()}
    assert out == {1: docs[0][1], 2: "\nabce", 3: "  ", 4: "  "}
    got = {r.doc_id: (r.n_lines, r.n_exact, r.n_near) for r in line_dedup.report(frame(spark, docs)).collect()}
    assert got == {1: (5, 0, 0), 2: (5, 2, 1), 3: (5, 2, 2), 4: (2, 1, 0)}


def test_short_lines_against_all_pairs(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice("abc d") for _ in range(rng.randint(4, 16))) for _ in range(25)]
    docs = [(d, "\n".join(changed(rng, rng.choice(base), rng.randint(0, 3)) if d % 2 else rng.choice(base) for _ in range(6))) for d in range(30)]
    assert got_report(spark, docs) == line_report(docs)[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("4111 1111 1111 1111 12/25", ["4111 1111 1111 1111"]),
        ("4111111111111111 123", ["4111111111111111"]),
        ("5 4111 1111 1111 1111", ["4111 1111 1111 1111"]),
        ("1234-4111-1111-1111-1111", ["4111-1111-1111-1111"]),
        ("4111-1111-1111-1111-2025-06", ["4111-1111-1111-1111"]),
        ("4111 1111 1111 1112 123", []),
        ("7 2024-01-31 4111 1111 1111 1111", ["2024-01-31", "4111 1111 1111 1111"]),
        ("30-02-2020 4111 1111 1111 1111", ["4111 1111 1111 1111"]),
        ("AT61 1904 3002 3457 3201 USD", ["AT61 1904 3002 3457 3201"]),
        ("AT611904300234573201 EUR", ["AT611904300234573201"]),
        ("GB82 WEST 1234 5698 7654 32 PAID", ["GB82 WEST 1234 5698 7654 32"]),
        ("12/31/2020, 31/12/2020, 02/30/2020", ["12/31/2020", "31/12/2020"]),
        ("4111 1111 1111 1111.a@example.com", ["1111.a"]),
    ],
)
def test_valid_numbers_are_found_beside_others(text, want):
    fresh, found = pii.mask_text(text, b"k")
    assert [text[a:b] for _, a, b in found] == want and len(fresh) == len(text)
    for kind, a, b in found:
        assert fresh[a:b] != text[a:b] and pii.pseudonym(kind, fresh[a:b], b"k", True) == text[a:b]


def test_month_first_dates_stay_month_first():
    days = [f"{m:02d}/{d}/2{y:03d}" for m in (1, 6, 12) for d in (13, 28) for y in range(99)]
    fresh = [pii.pseudonym("date", d, b"k") for d in days]
    assert len(set(fresh)) == len(days) and all(int(x[:2]) <= 12 < int(x[3:5]) for x in fresh)
    assert [pii.pseudonym("date", x, b"k", True) for x in fresh] == days
