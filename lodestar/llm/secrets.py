"""Secrets in texts, by their form and by the entropy of what looks like a key.

Native: DataFrame functions only. Three kinds go by their form alone: an assignment to a name such as ``token``, an access
key id, and a long run of hex digits. Matches are found from the left without overlap by one pass of an anchored expression that
takes the text between them too, so that lengths add up to places.

Further spans go by entropy. Candidates are runs of key characters. In the parts of a candidate that belong to one
character class (hex digits, letters and digits, base64) a window of ``Class.window`` characters slides along. Its counts by character are
kept, six bits each, in a few longs: a step takes one from the count of the character that leaves and adds one
to that of the character that enters. So does the sum of c log2 c, in whole numbers, by a table of its few values. A window is hot if its Shannon
entropy reaches the class's bound and it has both a letter and a digit; hot windows that touch are one span.

Spans within a match of ``ALLOWED_CONTEXT`` (addresses, identifiers, digests of files) and spans that hold
``ALLOWED_TEXT`` (alphabets in order, placeholders) are suppressed; so are those within a span that is listed before them. Neither touches
what goes by form.

Edge cases: null and empty texts have no spans; texts of any length are scanned whole, long runs in overlapping pieces whose
spans are united; each row has its result, so repeated rows and ids do; an empty table gives an empty table; further columns are ignored by
``report`` and kept by the others. Places count code points, the end excluded.
"""

from __future__ import annotations

import dataclasses
import functools
import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import fresh_name

#: Forms of secrets, the group that is measured (0: the whole match) and the least characters of it.
FORMS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}
@dataclasses.dataclass(frozen=True)
class Class:
    """Characters of a class, the window that slides over them, and the least entropy in bits of a hot one."""

    name: str
    characters: str
    pattern: str
    window: int
    bits: float

    def most(self) -> int:
        """Most that the sum of c log2 c may be, in 2**-SCALE: entropy is log2(window) less that sum by the window."""
        return math.floor((math.log2(self.window) - self.bits) * self.window * 2**SCALE)


SCALE = 20
_ALNUM = string.digits + string.ascii_letters
CLASSES = (
    Class("entropy_hex", string.digits + "abcdefABCDEF", "[0-9A-Fa-f]", 20, 3.0),
    Class("entropy_alnum", _ALNUM, "[0-9A-Za-z]", 20, 3.5),
    Class("entropy_base64", _ALNUM + "+/_=-", "[0-9A-Za-z+/_=-]", 24, 4.0),
)
KINDS = (*FORMS, *(c.name for c in CLASSES))
#: Runs of fewer characters have no window, and none is a long run of hex digits.
_CANDIDATE = r"(?<![0-9A-Za-z+/_=-])[0-9A-Za-z+/_=-]{20,}"
#: A text in lower case that has an assignment has one of these words; it spares most texts the slower search.
_WORDS = ("passw", "secret", "token", "apikey", "api_key")
#: Text around spans that are no secrets: addresses, UUIDs, digests named as such, inline images.
ALLOWED_CONTEXT = r"""https?://[^\s"'<>]+|\b[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\b|(?i:md5|sha-?(?:1|224|256|384|512))[-:=\x20]+[0-9A-Za-z+/=]+|data:[a-z]+/[a-z0-9.+-]+;base64,[0-9A-Za-z+/=]+"""
#: Text within spans that are no secrets.
ALLOWED_TEXT = r"(?i)example|placeholder|changeme|0123456789|1234567890|abcdefghij|qwertyuiop"
#: Elements of one piece, where sums or windows run along an array.
_PIECE = 1024


def _let(value: Column, use) -> Column:
    """``use(value)``, the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(lengths: Column) -> Column:
    """Sums of the elements up to each one; by pieces, so that the time doesn't grow with the square of the array."""
    cuts = lambda n: F.sequence(F.lit(0), F.floor((n - 1) / _PIECE).cast("int"))
    pieces = lambda x: F.transform(cuts(F.size(x)), lambda k: F.slice(x, k * _PIECE + 1, F.lit(_PIECE)))
    start = lambda zero: F.struct(zero.cast("bigint").alias("n"), F.array().cast("array<bigint>").alias("all"))
    add = lambda s, x: F.struct((s["n"] + x).alias("n"), F.concat(s["all"], F.array(s["n"] + x)).alias("all"))
    sums = lambda x: F.aggregate(x, start(F.lit(0)), add, lambda s: s["all"])
    total = lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda s, v: s + v)
    whole = lambda x: _let(pieces(x), lambda ps: _let(sums(F.transform(ps, total)), lambda ends: F.flatten(F.transform(ps, lambda p, k: F.transform(sums(p), lambda v: v + F.when(k > 0, F.get(ends, k - 1)).otherwise(F.lit(0)))))))
    return F.when(F.size(lengths) > _PIECE, whole(lengths)).otherwise(sums(lengths))


def matches(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Array of (start, end, value) of the matches, from the left without overlap, whose ``group`` has ``least`` characters."""
    anchored = F.lit(rf"(?s)\G(.*?)({pattern})")
    found = lambda i: F.regexp_extract_all(text, anchored, F.lit(i))
    sizes = F.transform(found(0), lambda x: F.char_length(x).cast("bigint"))
    measured = found(2 + group) if group else F.array().cast("array<string>")
    rows = F.arrays_zip(_running(sizes).alias("end"), found(2).alias("value"), measured.alias("part"))
    if least:
        rows = F.filter(rows, lambda x: F.char_length(x["part" if group else "value"]) >= least)
    return F.transform(rows, lambda x: F.struct((x["end"] - F.char_length(x["value"])).alias("start"), x["end"].alias("end"), x["value"].alias("value")))


_SPANS = "array<struct<start:bigint,order:int,end:bigint>>"


def _no_spans() -> Column:
    return F.array().cast(_SPANS)


def _span(start: Column, order: int, end: Column) -> Column:
    return F.struct(start.cast("bigint").alias("start"), F.lit(order).alias("order"), end.cast("bigint").alias("end"))


def _united(spans: Column) -> Column:
    """Spans in order of their starts and ends, those that touch as one."""
    starts = F.filter(spans, lambda x, i: (i == 0) | (F.get(spans, i - 1)["end"] < x["start"]))
    ends = F.filter(spans, lambda x, i: (i == F.size(spans) - 1) | (F.get(spans, i + 1)["start"] > x["end"]))
    return F.transform(starts, lambda x, i: F.struct(x["start"].alias("start"), x["order"].alias("order"), F.get(ends, i)["end"].alias("end")))


def hot_windows(run: Column, of: Class, order: int) -> Column:
    """Spans of the hot windows of a run of characters of one class."""
    w = of.window
    table = [round(c * math.log2(c) * 2**SCALE) if c else 0 for c in range(w + 2)]
    gains = F.array(*(F.lit(b - a).cast("bigint") for a, b in zip(table, table[1:], strict=False)))  # of a count c that becomes c + 1
    per = 10  # counts in a long

    def count(counts: Column, code: Column) -> Column:
        return F.call_function("shiftright", F.get(counts, F.floor(code / per).cast("int")), 6 * (code % per)).bitwiseAND(F.lit(63)).cast("int")

    def moved(counts: Column, code: Column, by: int) -> Column:
        one = F.call_function("shiftleft", F.lit(by).cast("bigint"), 6 * (code % per))
        return F.transform(counts, lambda x, k: F.when(k == F.floor(code / per), x + one).otherwise(x))

    def step(codes: Column):
        def move(s: Column, i: Column) -> Column:
            left, came = F.get(codes, i - w), F.get(codes, i)
            without = F.when(left.isNull(), F.struct(s["counts"].alias("counts"), s["sum"].alias("sum"))).otherwise(
                F.struct(moved(s["counts"], left, -1).alias("counts"), (s["sum"] - F.get(gains, count(s["counts"], left) - 1)).alias("sum"))
            )
            digits = s["digits"] + (came < 10).cast("int") - F.coalesce((left < 10).cast("int"), F.lit(0))
            letters = s["letters"] + came.between(10, 61).cast("int") - F.coalesce(left.between(10, 61).cast("int"), F.lit(0))

            def finish(t: Column) -> Column:
                total = t["sum"] + F.get(gains, count(t["counts"], came))
                last = F.get(s["spans"], F.size(s["spans"]) - 1)
                window = F.array(_span(i - (w - 1), order, i + 1))
                grown = F.concat(F.slice(s["spans"], F.lit(1), F.size(s["spans"]) - 1), F.array(_span(last["start"], order, i + 1)))
                spans = F.when((i < w - 1) | (total > of.most()) | (digits < 1) | (letters < 1), s["spans"]).when(last["end"] >= i - (w - 1), grown).otherwise(F.concat(s["spans"], window))
                return F.struct(moved(t["counts"], came, 1).alias("counts"), total.alias("sum"), digits.alias("digits"), letters.alias("letters"), spans.alias("spans"))

            return _let(without, finish)

        return move

    zeros = F.array(*[F.lit(0).cast("bigint")] * -(-len(of.characters) // per))
    zero = F.struct(zeros.alias("counts"), F.lit(0).cast("bigint").alias("sum"), F.lit(0).alias("digits"), F.lit(0).alias("letters"), _no_spans().alias("spans"))

    def piece(k: Column) -> Column:
        """Windows that begin in the k-th piece of the run."""
        chars = F.split(F.substring(run, k * _PIECE + 1, F.lit(_PIECE + w - 1)), "")
        codes = F.transform(chars, lambda c: F.instr(F.lit(of.characters), c) - 1)
        spans = _let(codes, lambda x: F.aggregate(F.sequence(F.lit(0), F.size(x) - 1), zero, step(x), lambda s: s["spans"]))
        return F.transform(spans, lambda x: F.struct((x["start"] + k * _PIECE).alias("start"), x["order"].alias("order"), (x["end"] + k * _PIECE).alias("end")))

    cuts = F.sequence(F.lit(0), F.floor((F.char_length(run) - w) / _PIECE).cast("int"))
    return F.when(F.char_length(run) >= w, _let(F.flatten(F.transform(cuts, piece)), _united)).otherwise(_no_spans())


def _shifted(spans: Column, by: Column) -> Column:
    return F.transform(spans, lambda x: F.struct((x["start"] + by).alias("start"), x["order"].alias("order"), (x["end"] + by).alias("end")))


def _runs(candidates: Column) -> Column:
    """(start, order, value) of the runs of each class in the candidates that are as long as its window."""

    def of_class(c: Column, kind: Class, order: int) -> Column:
        found = matches(c["value"], f"{kind.pattern}{{{kind.window},}}")
        return F.transform(found, lambda r: F.struct((c["start"] + r["start"]).alias("start"), F.lit(order).alias("order"), r["value"].alias("value")))

    return F.flatten(F.transform(candidates, lambda c: F.concat(*(of_class(c, kind, order) for order, kind in enumerate(CLASSES, len(FORMS))))))


def _hot(runs: Column) -> Column:
    of = lambda kind, order: lambda r: _shifted(hot_windows(r["value"], kind, order), r["start"])
    own = lambda order: F.filter(runs, lambda r: r["order"] == order)
    return F.concat(*(F.flatten(F.transform(own(order), of(kind, order))) for order, kind in enumerate(CLASSES, len(FORMS))))


def _inside(x: Column, all_: Column, listed_before: bool) -> Column:
    """Whether a span lies within one of ``all_``, of those listed before it where they have an order."""
    within = lambda y: (y["start"] <= x["start"]) & (x["end"] <= y["end"])
    return F.exists(all_, (lambda y: (y["order"] < x["order"]) & within(y)) if listed_before else within)


def with_spans(docs: DataFrame, text: str = "text", name: str = "found", allowed_context: str = ALLOWED_CONTEXT, allowed_text: str = ALLOWED_TEXT) -> DataFrame:
    """The documents with ``name``, the sorted array of (start, order, end) of all spans; ``order`` counts in KINDS."""
    t, (candidates, runs, hot) = F.col(text).cast("string"), (fresh_name(x, docs) for x in ("candidates", "runs", "hot"))
    words = lambda low: functools.reduce(Column.__or__, (low.contains(w) for w in _WORDS))
    form = lambda kind: F.transform(matches(t, *FORMS[kind]), lambda x: _span(x["start"], KINDS.index(kind), x["end"]))
    plain = lambda x: F.substring(t, (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int")).rlike(allowed_text)
    rows = docs.withColumn(candidates, F.when(t.rlike(_CANDIDATE), matches(t, _CANDIDATE)))
    rows = rows.withColumn(runs, F.when(F.size(candidates) > 0, _runs(F.col(candidates))))
    rows = rows.withColumn(hot, F.when(F.size(runs) > 0, F.filter(_hot(F.col(runs)), lambda x: ~plain(x))))
    free = _let(matches(t, allowed_context), lambda allowed: F.filter(hot, lambda x: ~_inside(x, allowed, False)))
    # a long run of hex digits is within a candidate
    by_form = (F.when(_let(F.lower(t), words), form("assign")), F.when(t.contains("AKIA"), form("access")), F.when(F.size(candidates) > 0, form("hex")))
    rows = rows.withColumn(name, F.concat(*(F.coalesce(x, _no_spans()) for x in (*by_form, F.when(F.size(hot) > 0, free)))))
    kept = F.filter(name, lambda x: (x["order"] < len(FORMS)) | ~_inside(x, F.col(name), True))
    return rows.drop(candidates, runs, hot).withColumn(name, F.array_sort(kept))


def _named(span: Column) -> Column:
    return F.get(F.array(*map(F.lit, KINDS)), span["order"])


def find(docs: DataFrame, text: str = "text", name: str = "secrets", **allowed: str) -> DataFrame:
    """The documents with ``name``, an array of (kind, start, end)."""
    return with_spans(docs, text, name, **allowed).withColumn(name, F.transform(name, lambda x: F.struct(_named(x).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))))


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]", **allowed: str) -> DataFrame:
    """The documents with each span, or spans that overlap or touch, as ``mark``; null texts stay null."""
    name, t = fresh_name("found", docs), F.col(text).cast("string")
    cut = lambda a, b: F.substring(t, (a + 1).cast("int"), (b - a).cast("int"))
    # the end of a span that reaches beyond later ones counts for them too
    reach = F.transform(name, lambda x: F.struct(x["start"].alias("start"), x["order"].alias("order"), F.array_max(F.transform(F.filter(name, lambda y: y["start"] <= x["start"]), lambda y: y["end"])).alias("end")))
    merged = with_spans(docs, text, name, **allowed).withColumn(name, reach).withColumn(name, _united(F.col(name)))
    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(name, lambda x: x["end"]))
    starts = F.concat(F.transform(name, lambda x: x["start"]), F.array(F.char_length(t).cast("bigint")))
    kept = F.when(t.isNotNull(), F.array_join(F.zip_with(ends, starts, cut), mark))
    return merged.select(*(kept.alias(c) if c == text else c for c in docs.columns))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of each row; spans as kind:start:end, comma-joined, base ones those that go by form."""
    found = with_spans(docs.select("doc_id", "text"))
    listed = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", _named(s), s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda k: F.size(F.filter("found", lambda s: s["order"] == k)).cast("bigint")
    base = F.filter("found", lambda s: s["order"] < len(FORMS))
    return found.select("doc_id", *(number(k).alias(f"n_{kind}") for k, kind in enumerate(FORMS)), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
