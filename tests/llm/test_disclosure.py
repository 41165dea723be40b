"""Personal data: the patterns against plain ones, and revealing terms against a direct count."""

import hashlib
import math
import re
from collections import Counter, defaultdict

from hypothesis import given, settings, strategies as st

from loglantern.llm import disclosure as D
from loglantern.llm.queries import QUERIES

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def passes(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(v - 9 * (v > 9) for v in doubled) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def plain_spans(text):
    return [(k, *m.span()) for k, p in PLAIN.items() for m in p.finditer(text) if passes(k, m[0])]


PIECES = ["a.b", "@", "x-1", ".", "..", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (377) 555-0271", "+", "10.0.0.255", "256", ".1", " ", "é", "_", "%", "7", "00", "-", "(", "mail7.example.com"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_patterns(text):
    assert [tuple(s) for s in D.base_spans(text)] == plain_spans(text)


def test_long_runs_take_linear_time():
    assert D.base_spans("a" * 300_000 + " " + "1" * 300_000 + " " + "+" * 300_000 + " a@b." * 1000) == []


def plain_found(rows, most_share, least, reach):
    """(doc_id, text) -> revealing spans, counting every document directly."""
    company, having, docs = defaultdict(set), Counter(), []
    for text in rows:
        base = plain_spans(text)
        having.update({w.lower() for w in re.findall(r"[^\W_]{3,}", text)})
        words = [
            (m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W_]{3,}", text)
            if not any(a < m.end() and m.start() < b for _, a, b in base)
        ]
        near = defaultdict(set)
        for k, a, b in base:
            v = text[a:b].lower() if k in ("email", "ip") else re.sub("[^0-9]", "", text[a:b])
            near[k, v].add((None, a, b))
            left, right = [w for w in words if w[1] <= a], [w for w in words if w[0] >= b]
            near[k, v].update((t, x, y) for x, y, t in (left[-reach:] + right[:reach]))
        for e, own in near.items():
            company[e].add(tuple(t or "" for t, _, _ in sorted(own, key=lambda m: m[1:])))
        docs.append(near)
    n = len(rows)
    told = set()
    for e, seen in company.items():
        n_e = len(seen)
        for t in {t for c in seen for t in c if t}:
            both = sum(t in c for c in seen)
            if both >= least and n_e < n and math.log(n * both / n_e / having[t]) / math.log(n / n_e) >= most_share:
                told.add((e, t))
    return [sorted({(a, b) for e, own in near.items() for t, a, b in own if (e, t) in told}) for near in docs]


def texts_with_company():
    fill = "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore magna aliqua enim minim veniam quis nostrud".split()
    rows = [" ".join(fill[(i * 7 + j * 3) % 20] for j in range(30)) for i in range(60)]
    for i in range(6):
        rows.append(f"note {fill[i]} {fill[i + 4]} Doctor Zebedee Quint wrote from zq@mail.example.org about {fill[i + 8]} {fill[i + 2]}")
    rows += [f"call {fill[i]} {fill[i + 1]} +1 (377) 555-0271 now {fill[i + 2]} or zq@mail.example.org" for i in range(5)]
    return rows + [rows[-1]] * 4


def test_terms_equal_a_direct_count(spark):
    rows = texts_with_company()
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r for r in D.find_personal(df, 0.7, 2, 4).collect()}
    want = plain_found(rows, 0.7, 2, 4)
    assert len(got) == len(rows) and sum(map(len, want)) > 10
    for i, text in enumerate(rows):
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(text))
        terms = ",".join(f"term:{a}:{b}" for a, b in want[i])
        assert got[i].spans == ",".join(filter(None, [base, terms])) and got[i].n_term == len(want[i])
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert "Zebedee" in {rows[61][a:b] for a, b in want[61]}


def test_query_equals_a_direct_count(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    want = plain_found([r.text or "" for r in docs], 0.8, 2, 10)
    got = {r.doc_id: r for r in QUERIES["op12_personal_data"](spark, d).collect()}
    assert len(got) == len(docs)
    for r, terms in zip(docs, want):
        spans = plain_spans(r.text or "")
        assert got[r.doc_id].spans == ",".join(f"{k}:{a}:{b}" for k, a, b in spans + [("term", *t) for t in terms])
        assert [got[r.doc_id][f"n_{k}"] for k in PLAIN] == [sum(s[0] == k for s in spans) for k in PLAIN]


def test_sanitise(spark):
    rows = texts_with_company()
    df = spark.createDataFrame([(i, t, "k", i) for i, t in enumerate(rows)], "doc_id long, text string, key string, base int")
    got = {r.doc_id: r for r in D.sanitise(df, 0.7, 2, 4).collect()}
    assert got[61].key == "k" and got[61].base == 61 and got[0].text == rows[0]
    assert "Zebedee" not in got[61].text and "[email]" in got[61].text
    # A general word that other texts share reveals less and takes the term's place.
    general = {"zebedee": "person", **{w: "person" for w in "lorem ipsum dolor sit amet elit sed quis".split()}, "quint": "quint"}
    text = {r.doc_id: r.text for r in D.sanitise(df, 0.7, 2, 4, general).collect()}[61]
    assert "person" in text and "Quint" not in text and "quint" not in text


def test_odd_rows(spark):
    some = "Ada Lovelace wrote from ada@example.org to +44 20 7946 0958"
    rows = [(1, some), (1, some), (None, some), (2, None), (None, None), (3, ""), (4, "x " * 100_000 + some), (5, "10.0.0.1")]
    df = spark.createDataFrame([(*r, None, "m", 7) for r in rows], "doc_id long, text string, key string, mentions string, n_t int")
    got = D.find_personal(df).collect()
    assert Counter(r.doc_id for r in got) == {1: 2, None: 2, 2: 1, 3: 1, 4: 1, 5: 1}
    by = {r.doc_id: r for r in got if r.doc_id}
    assert by[1].n_email == by[1].n_phone == 1 and by[4].n_email == 1 and by[5].spans == "ip:0:8" and by[2].spans == by[3].spans == ""
    assert D.find_personal(df.limit(0)).count() == 0 == D.sanitise(df.limit(0)).count()
    clean = D.sanitise(df)
    assert clean.columns == df.columns
    assert Counter(r.doc_id for r in clean.collect()) == Counter(r.doc_id for r in got)
    assert [r.text for r in clean.where("doc_id = 2").collect()] == [None]
