"""The Merkle manifest against plain Python that hashes level by level."""

import collections
import hashlib
import random
import zlib

import pytest

from lodestar.llm import merkle


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tampered(row):
    if row[0] is None or row[4] is None or zlib.crc32(str(row[0]).encode()) % 2:
        return row
    return (*row[:4], row[4].replace("\n", ""))


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, i):
    out = []
    for level in tree[:-1]:
        low = i - i % 3
        out.append(("".join(level[low:i]), "".join(level[i + 1 : low + 3])))
        i //= 3
    return out


def plain_audit(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    names = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {}
    for k in names:
        groups[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[k] = levels([leaf_of(r) for r in groups[k]])
    top = levels([trees[k][-1][0] for k in names])
    out = []
    for n, k in enumerate(names):
        for i, r in enumerate(groups[k]):
            steps, h = siblings(trees[k], i) + siblings(top, n), leaf_of(tampered(r))
            for a, b in steps:
                h = digest(a + h + b)
            out.append((r[0], leaf_of(r), trees[k][-1][0], top[-1][0], digest("".join(a + b for a, b in steps)), h, h == top[-1][0]))
    return sorted(out, key=repr)


def frame(spark, rows):
    # further columns whose names the operator uses itself
    return spark.createDataFrame([(*r, "x", "y", 0) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, grp string, leaf string, part int")


def audited(spark, rows):
    return sorted(map(tuple, merkle.audit(frame(spark, rows)).collect()), key=repr)


ODD = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "", 0, ""), (None, "a", "en", 3, "x\ny"), (None, "a", "en", 3, "x\ny"), (4, "ä", "日", 1, "\n" * 50), (-5, "a", None, 2, "t" * 100_000), (0, "z", "en", 1, "🙂\n")]


@pytest.mark.parametrize("merged", [2, 64])
def test_audit_equals_plain_python(spark, monkeypatch, merged):
    monkeypatch.setattr(merkle, "MERGED", merged)
    monkeypatch.setattr(merkle, "PART_LEAVES", 9)  # many unaligned edges
    rng = random.Random(merged)
    rows = [(i, rng.choice(["hot", "hot", "hot", "b", None, "ü"]), "en", 4, rng.choice(["a\nb", "c", None, f"{i}\n"])) for i in rng.sample(range(10**6), 150)]
    assert audited(spark, rows + ODD) == plain_audit(rows + ODD)


def test_small_and_empty_tables(spark):
    assert audited(spark, []) == []
    for rows in (ODD[:1], ODD[:2], ODD[2:3], ODD):
        assert audited(spark, rows) == plain_audit(rows)


def test_proofs_lead_to_the_root_and_only_from_their_leaf(spark):
    rows = [(i, "s" if i % 3 else "t", "en", 1, f"text {i}") for i in range(40)]
    of = merkle.manifest(merkle.document_leaves(frame(spark, rows)))
    root = of.subroots.first()["root"]
    found = merkle.proofs(of).collect()
    assert len(found) == 40 and all(merkle.folded(r.leaf, [(s.left, s.right) for s in r.steps]) == root for r in found)
    assert merkle.folded(digest("other"), [(s.left, s.right) for s in found[0].steps]) != root


@pytest.mark.parametrize("total", [1, 2, 3, 4, 9, 10, 28, 82])
def test_stack_completes_any_cut(total):
    leaves = [digest(str(i)) for i in range(total)]
    want = levels(leaves)
    for cut in range(total + 1):
        parts = []
        for low, high in ((0, cut), (cut, total)):
            stack = merkle.Mountains(total)
            for i in range(low, high):
                list(stack.push(0, i, leaves[i]))
            parts += stack.peaks
        whole = merkle.Mountains(total)
        made = {x[:2]: x[2] for p in parts for x in [*whole.push(*p), p]}
        assert whole.peaks == [(len(want) - 1, 0, want[-1][0])]
        assert all(want[level][i] == d for (level, i), d in made.items())
