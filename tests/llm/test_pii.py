import hashlib
import re

import pyarrow.parquet as pq

from terralens.llm import pii

P = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    found = []
    for k, (kind, p) in enumerate(P.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (12 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            found.append((m.start(), k, m.end()))
    joined = ",".join(f"{list(P)[k]}:{s}:{e}" for s, k, e in sorted(found))
    return tuple(sum(x[1] == k for x in found) for k in range(4)), hashlib.sha256(joined.encode()).hexdigest(), joined


def check(rows, got):
    assert len(rows) == len(got)
    by = {r.doc_id: r for r in got}
    for d, t in rows:
        want, r = brute(t), by[d]
        assert ((r.n_email, r.n_ip, r.n_card, r.n_phone), r.base_sha256) == want[:2], (t or "")[:200]
        assert set(filter(None, want[2].split(","))) <= set(r.spans.split(","))
        assert len(r.scores) == len(list(filter(None, r.spans.split(",")))) and all(0 <= x <= 1 for x in r.scores)


def test_table(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    t = pq.read_table(path, columns=["doc_id", "text"])
    rows = list(zip(*(c.to_pylist() for c in t.columns), strict=True))
    assert any(sum(brute(x)[0]) for _, x in rows)
    check(rows, pii.report(spark.read.parquet(path)).collect())


EDGES = [None, "", "a@b.c_d@e.f a@b.c", "é x@y z@w.v. é@é.de ..@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4", "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 1111 1111",
         "41111111111111111111111111", "+1 (555) 010-9999 and +1234 +49 30 1234567.89", "1-2-3-4-5-6-7-8-9-0-1-2-3", "x" * 15000, "1" * 15000, "1 2 " * 20000, "a.b" * 5000 + "@", "a@b" + ".c" * 60000,
         "+1" + "(" * 50000, "中文 a@b.co 中", "IBAN GB82 WEST 1234 5698 7654 32 ok", "GB82 WEST 1234 5698 7654 33", "ssn 123-45-6789", "123-45-6789", "a@b.cc " * 1500, "1.1.1.1,2.2.2.2+1.1.1.1.1.1.1.1", "0 4111111111111111", "5" * 11 + " 5-" * 3]


def test_edges(spark):
    rows = list(enumerate(EDGES))
    docs = spark.createDataFrame([(d, t, "f", [1], "r") for d, t in rows], "doc_id long, text string, found string, m_email array<int>, row string")
    got = pii.report(docs).collect()
    check(rows, got)
    by = {r.doc_id: r for r in got}
    assert "iban:5:32" in by[16].spans and "iban" not in by[17].spans
    assert by[18].spans == "ssn:4:15" and by[19].spans == ""
    assert pii.report(docs.limit(0)).count() == 0


def test_redact(spark):
    docs = spark.createDataFrame([(1, "mail a@b.co or +1 555 010 9999!", 5, "s"), (2, None, 0, "s"), (3, "clean", 5, "s"), (4, "a@b.co", 6, None)], "doc_id long, text string, n_chars long, source string")
    got = pii.redact(docs)
    assert got.columns == docs.columns and got.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    assert {r.doc_id: (r.text, r.n_chars) for r in got.collect()} == {1: ("mail [EMAIL] or [PHONE]!", 24), 2: (None, None), 3: ("clean", 5), 4: ("[EMAIL]", 7)}


G, D, N = "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "NO93 8601 1117 947"
#: Texts with bank account numbers, {} each, before and after capitals and digits.
IBANS = [("{} Please pay", [G]), ("{} EUR", [D]), ("{} BIC: X", ["GB82WEST12345698765432"]), ("é {} 12 A {} {} OK", [G, D, N]), ("SE25 {} {}", [G, D]), ("REF AB12 {} 7", [N]), ("{}", ["BR1500000000000010932840814P2"]),
         ("{}, {}.", [N, "MT31MALT01100000000000000000123"])]
NOT_IBANS = ["GB82 WEST 1234 5698 7654 33 Please", D + "1 EUR", D + "x", "x" + D, "GB82" * 5000, "AB12 " * 5000, "SE25 GB82 " * 3000]


def iban_spans(t, parts):
    out, at = [], 0
    for n in parts:
        s = t.index(n, at)
        out.append((s, at := s + len(n)))
    return out


def test_iban_ends_with_its_country(spark):
    rows = [(k, t.format(*n)) for k, (t, n) in enumerate(IBANS)] + [(100 + k, t) for k, t in enumerate(NOT_IBANS)]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, t in rows:
        want = iban_spans(t, IBANS[k][1]) if k < 100 else []
        assert [tuple(map(int, x.split(":")[1:])) for x in got[k].split(",") if x.startswith("iban")] == want, t[:200]


def test_spans_far_into_a_text(spark):
    """Marks and contexts come from the right places, over block borders and after characters of any width."""
    rows = [(k, ("é𝄞x" * k) + f" mail a{k}@b.co, 4111 1111 1111 1111+1 555 010 9999 " + "中 " * (600 - k) + "1.2.3.4 a@b.cc+49 30 12345678") for k in range(150, 530, 19)]
    rows += [(1, "a@b.cc 1.2.3.4 " * 700), (2, "+1 555 010 9999 x " * 33 + "tail"), (3, "+4111111111111111 a@b.co1.2.3.4")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, pii.report(docs).collect())

    def redacted(t):
        out, at = [], 0
        for s, k, e in sorted((int(s), list(P).index(k), int(e)) for k, s, e in (x.split(":") for x in brute(t)[2].split(",") if x)):
            if s >= at:
                out.append(t[at:s] + f"[{list(P)[k].upper()}]")
            at = max(at, e)
        return "".join(out) + t[at:]
    assert {r.doc_id: r.text for r in pii.redact(docs).collect()} == {d: redacted(t) for d, t in rows}


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a@b.co"), (1, "a@b.co"), (1, "x"), (None, "a@b.co")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_email) for r in pii.report(docs).collect()) == [("1", 0), ("1", 1), ("1", 1), ("None", 1)]
