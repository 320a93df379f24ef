"""Archives as files, token totals recounted, and what compaction reads."""

import collections
import gzip
import hashlib
import re

import public_tokenizers as P
import pytest
import tiktoken

from lodestar.llm import bpe, common, decontam, queries, token_counts, warc


def test_archives_as_files(spark, tmp_path):
    body = lambda t: b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n" + t
    plain = warc.arc_header(1, "a.arc", "1999") + b"http://x.org/with a blank 1.2.3.4 19990102030405 text/html %d\n" % len(body(b"one")) + body(b"one") + b"\n"
    parts = [warc.arc_header(2, "b.arc.gz", "2001"), *(warc.arc_record(2, f"http://y.org/{i}", "20010101", body(b"page %d\nhttp://z 0 1 a 5\n" % i)) for i in range(3))]
    (tmp_path / "a.arc").write_bytes(plain)
    (tmp_path / "b.arc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    rows = warc.read_arc(spark, f"file://{tmp_path}")
    got = sorted((r.file.rsplit("/", 1)[1], r.nth, r.url, r.archive_date, bytes(r.body)) for r in rows.collect())
    assert got[0] == ("a.arc", 0, "http://x.org/with a blank", "19990102030405", body(b"one")) and [r[:3] for r in got[1:]] == [("b.arc.gz", i, f"http://y.org/{i}") for i in range(3)]
    warc.write_warc(warc.convert_arc(rows), f"file://{tmp_path}/warc")
    back = warc.read_warc(spark, f"file://{tmp_path}/warc").collect()
    assert {(r.url, r.payload_digest) for r in back} == {(r[2], hashlib.sha1(r[4].partition(b"\r\n\r\n")[2]).hexdigest()) for r in got}
    assert {r.type for r in back} == {"response"} and len({r.record_id for r in back}) == 4


def test_archives_that_are_no_archives():
    head = warc.arc_header(1, "x", "2026")
    for data, said in ((head.replace(b"1 0 lodestar", b"7 0 lodestar"), "version 7"), (head + b"http://x 0 2026 9\n", "4 fields"), (b"http://x 0 2026 text/html 0\n", "filedesc"), (head + b"http://x", "no end")):
        with pytest.raises(ValueError, match=said):
            list(warc.parse_arc(data))


def test_query_of_batches_equals_a_recount(spark, tmp_path):
    docs = [(i, None if i == 13 else f"text  {i}\n\n of some   words " * (i % 4), ["en", None][i % 2], f"s{i % 3}") for i in range(60)]
    spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    want = collections.Counter()
    for name in (queries.VOCABULARY, queries.SECOND_VOCABULARY):
        enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path(name)), special_tokens={})
        for i, text, lang, source in docs:
            if i % 17 != 5:
                text = re.sub(r"[ \n]+", " ", text or "") if i % 10 == 3 else text or ""
                key = (source, lang, name.partition(".")[0])
                want += collections.Counter({(*key, "docs"): 1, (*key, "tokens"): len(enc.encode_ordinary(text)), (*key, "bytes"): len(text.encode())})
    got = {(r.source, r.lang, r.tokenizer, c): r[c] for r in queries.op4_token_counts(spark, f"file://{tmp_path}").collect() for c in ("docs", "tokens", "bytes")}
    assert {k: v for k, v in got.items() if v} == dict(want)


def test_compaction_prunes(spark, tmp_path, monkeypatch):
    row = spark.createDataFrame([("s", "en", "v", 2, 5, 1)], "source string, lang string, tokenizer string, n_tokens long, n_bytes long, sign long").coalesce(1)
    r = token_counts.Rollup(spark, f"file://{tmp_path}/r")
    for i in range(5):
        assert r.commit(f"b{i}", row)
    assert r.compact() == 1
    r.commit("late", row)
    files = r.totals().inputFiles()
    assert len([f for f in files if "/delta/" in f]) == 1 and "batch_id=late" in "".join(files) and not any(f"batch_id=b{i}" in f for f in files for i in range(5))
    assert r.compact() == 2 and not (tmp_path / "r/delta/batch_id=late").exists() and not (tmp_path / "r/base/1").exists()
    assert [(x.docs, x.tokens, x.bytes) for x in r.totals().collect()] == [(6, 12, 30)] and not r.commit("b0", row)
    monkeypatch.setattr(token_counts, "MAX_OPEN", 1)
    r.commit("x", row)
    r.commit("y", row)
    with pytest.raises(ValueError, match="compaction"):
        r.totals()


def test_hits_of_shards_with_clashing_names(spark):
    docs = spark.createDataFrame([(i, f"one two three four five six seven eight nine ten {i}") for i in range(8)], "hits long, items string")
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, "two three four five six seven eight nine ten 3 more")], "item_id long, text string")
    one, many = (sorted((r.hits, r.n_hit, r.n_items) for r in decontam.contamination(docs, bench, key="hits", text="items", limit=limit).collect()) for limit in (10**6, 60))
    assert one == many and [r[1] for r in one] == [10, 10, 10, 11, 10, 10, 10, 10]


def test_scratch_is_cleared(spark):
    df = common.materialise(spark.range(3), "cleared")
    path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert common.clear_scratch(spark) > 0
    import os

    assert not os.path.exists(path) and common.clear_scratch(spark) == 0
