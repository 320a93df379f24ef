"""The pipeline against plain Python, stage by stage, over a small fixture."""

import hashlib
import random

import public_tokenizers as P
import tiktoken
from test_operators import RANKS, changed, line_report, near_classes

import corpus_pipeline
from lodestar.llm import bpe, decontam, quality


def fixture(rng):
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 8)))
    line = lambda: " ".join(word() for _ in range(12))
    common = [line() for _ in range(4)]
    docs = [(i, "\n".join([line() for _ in range(4)] + rng.sample(common, 1) + [changed(rng, rng.choice(common), 2)])) for i in range(30)]
    docs += [(100 + i, "JUNK!! MORE!! " * 20) for i in range(6)]
    # lines broken at other words survive line dedup, so that these are near copies after it too
    base = [word() + "en" for _ in range(150)]
    for i in range(4):
        words = list(base)
        words[i * 30] = "other"
        docs.append((200 + i, "\n".join(" ".join(words[k : k + 11 + i]) for k in range(0, 150, 11 + i))))
    docs += [(300, docs[0][1].split("\n")[0] + " and more"), (301, None), (302, ""), (303, "ünï 日本 🙂")]
    return docs, [(1, docs[5][1].split("\n")[0]), (2, None)]


def one_each(rows):
    least = near_classes(rows)
    return [(d, t) for d, t in rows if least[d] == d]


def test_stages_equal_plain_python(spark, tmp_path):
    docs, items = fixture(random.Random(9))
    base = f"file://{tmp_path}"
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(d, int(not 100 <= d < 200), 0) for d, _ in docs], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    df, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    good = {r.doc_id for r in quality.scores(df, quality.train(df, labels)).collect() if r.predicted}
    rows = [(d, t) for d, t in docs if d in good]
    assert not any(100 <= d < 200 for d in good) and len(good) >= 35
    texts = line_report(rows)[1]
    rows = [(d, texts[d]) for d, _ in rows]
    rows = one_each(rows)
    assert [d for d, _ in rows if 200 <= d < 300] == [200]
    window = decontam.words_of(items[0][1])
    holds = lambda t: any(w[i : i + 10] == window[k : k + 10] for w in [decontam.words_of(t)] for k in range(max(1, len(window) - 9)) for i in range(len(w) - 9))
    rows = [(d, t) for d, t in rows if not holds(t)]
    assert 5 not in dict(rows)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    want = []
    for d, t in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(tuple(r)[:4] for r in corpus_pipeline.run(spark, base).collect()) == sorted(want)
