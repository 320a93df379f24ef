"""Secret scans against plain Python: ``re`` for the forms, every window counted anew for the entropy."""

import collections
import hashlib
import math
import random
import re
import string

from lodestar.llm import secrets

FORMS = {
    "assign": (r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}


def by_form(text):
    return [(m.start(), k, m.end()) for k, (form, group, least) in enumerate(FORMS.values()) for m in re.finditer(form, text) if len(m[group]) >= least]


def hot(window, of):
    entropy = -sum(c / len(window) * math.log2(c / len(window)) for c in collections.Counter(window).values())
    return entropy >= of.bits - 1e-5 and re.search("[0-9]", window) and re.search("[A-Za-z]", window)


def by_entropy(text):
    out = []
    for c in re.finditer(r"[0-9A-Za-z+/_=-]{20,}", text):
        for order, of in enumerate(secrets.CLASSES, 3):
            for run in re.finditer(of.pattern + "+", c[0]):
                spans = []
                for i in range(len(run[0]) - of.window + 1):
                    if hot(run[0][i : i + of.window], of):
                        if spans and spans[-1][1] >= i:
                            spans[-1][1] = i + of.window
                        else:
                            spans.append([i, i + of.window])
                at = c.start() + run.start()
                out += [(at + a, order, at + b) for a, b in spans if not re.search(secrets.ALLOWED_TEXT, run[0][a:b])]
    allowed = [m.span() for m in re.finditer(secrets.ALLOWED_CONTEXT, text)]
    return [x for x in out if not any(a <= x[0] and x[2] <= b for a, b in allowed)]


def plain_report(doc_id, text):
    text = text or ""
    base = sorted(by_form(text))
    both = base + by_entropy(text)
    both = sorted(x for x in both if x[1] < 3 or not any(y[1] < x[1] and y[0] <= x[0] and x[2] <= y[2] for y in both))
    listed = lambda rows: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in rows)
    return (doc_id, *(sum(x[1] == k for x in base) for k in range(3)), hashlib.sha256(listed(base).encode()).hexdigest(), listed(both))


def some_text(rng):
    key = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    alnum = string.ascii_letters + string.digits
    pieces = [
        lambda: rng.choice(["Token", "api_key", "APIKEY", "secret", "password", "passwd"]) + rng.choice(["=", ": ", "' : \"", " =  "]) + key(alnum + "+/_.=-", rng.randint(3, 14)),
        lambda: "AKIA" + key(string.ascii_uppercase + string.digits, rng.randint(8, 16)),
        lambda: key("0123456789abcdef", rng.randint(18, 40)),
        lambda: key("0123456789ABCDEF", 24),
        lambda: key(alnum, rng.randint(18, 44)),
        lambda: key(alnum + "+/", rng.randint(22, 60)) + "==",
        lambda: "https://x.org/" + key(alnum, 30),
        lambda: "sha256-" + key(alnum, 43) + "=",
        lambda: "abcdefghijklmnopqrstuvwxyz0123456789",
        lambda: "-".join(key("0123456789abcdef", n) for n in (8, 4, 4, 4, 12)),
        lambda: "a-long-title-of-22-words-and-no-more-than-that",
        lambda: "ünï日本🙂 words",
        lambda: key(string.ascii_lowercase, 30),
        lambda: key(string.digits, 30),
    ]
    return rng.choice([" ", "\n", ", ", ""]).join(rng.choice(pieces)() for _ in range(rng.randint(1, 12)))


def rows_of(spark, rows):
    # further columns whose names the operator uses itself
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, found int, runs string, hot int")


def test_report_equals_plain_python(spark):
    rng = random.Random(12)
    rows = [(i, some_text(rng)) for i in range(250)]
    rows += [(900, None), (901, ""), (None, "token=abcdefgh"), (902, "x" * 5000), (902, "x" * 5000), (903, "token: secret= 'abcdefghij'"), (904, "token=token=abcdefgh"), (905, "\n".join(f"token={i:09d}" for i in range(2500)))]
    # longer than a piece, cold and hot parts in turn
    blob = "".join(rng.choice(["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(rng.randint(10, 700))), "a" * rng.randint(30, 900)]) for _ in range(16))
    rows += [(906, blob), (907, "é" + blob[:1500] + " " + blob[1500:2700])]
    got = sorted(map(tuple, secrets.report(rows_of(spark, rows)).collect()), key=repr)
    want = sorted((plain_report(*r) for r in rows), key=repr)
    assert got == want
    assert all(any(f"{kind}:" in r[5] for r in got) for kind in secrets.KINDS)
    assert secrets.report(rows_of(spark, [])).collect() == []


def test_planted_keys_are_found_and_plain_texts_left_alone(spark):
    keys = ["ghp_aB3dE5fG7hI9jK1lM3nO5pQ7rS9tU1vW3xY5", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzQk9LpT2Vd", "9f86d081884c7d659a2fEAa0"]
    plain = ["donaudampfschifffahrtsgesellschaft", "an-ordinary-title-with-hyphens-and-words", "https://host.org/2020/a8f5f167f44f4964e6c998dee827110c0", "123e4567-e89b-12d3-a456-426614174000", "1" * 60]
    rows = [(i, f"before {k} after") for i, k in enumerate(keys)] + [(100 + i, f"before {p} after") for i, p in enumerate(plain)]
    got = {r.doc_id: r for r in secrets.find(rows_of(spark, rows)).collect()}
    assert all(got[i].secrets[0].start == 7 and max(s.end for s in got[i].secrets) == 7 + len(k) for i, k in enumerate(keys))
    assert [i for i in range(len(plain)) if [s for s in got[100 + i].secrets if s.kind.startswith("entropy")]] == []
    redacted = {r.doc_id: r for r in secrets.redact(rows_of(spark, [*rows, (500, None)])).collect()}
    assert redacted[0].text == "before [secret] after" and redacted[100].text == rows[3][1] and redacted[500].text is None and redacted[0].runs == "x"


def test_no_python_in_the_plan(spark):
    plan = secrets.report(rows_of(spark, [(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
