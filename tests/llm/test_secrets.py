import base64
import hashlib
import json
import re

import pyarrow.parquet as pq

from terralens.llm import secrets

A = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in A.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))
    return tuple(sum(x[1] == k for x in found) for k in range(3)), hashlib.sha256(joined.encode()).hexdigest(), joined


def der(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else b"\x82" + n.to_bytes(2, "big")) + body


def seq(*parts):
    return der(0x30, b"".join(parts))


def text_of(b):
    return len(b).to_bytes(4, "big") + b


RSA = seq(der(2, b"\0"), der(2, b"\1" * 129), der(2, b"\1\0\1"), *(der(2, b"\7" * n) for n in (128, 64, 64, 64, 64, 63)))
KEY = RSA
OID = der(6, b"\x2a\x86\x48\x86\xf7\x0d\1\1\1")
PKCS8 = seq(der(2, b"\0"), seq(OID, der(5, b"")), der(4, RSA))
SEALED = seq(seq(OID, seq(der(4, b"salt" * 4))), der(4, b"\5" * 64))
CURVE = seq(der(2, b"\1"), der(4, b"\6" * 32), der(0xA0, der(6, b"\x2b\x81\4\0\x22")))
SSH_PUBLIC = text_of(b"ssh-ed25519") + text_of(b"\2" * 32)
OPENSSH = b"openssh-key-v1\0" + text_of(b"none") * 2 + text_of(b"") + (1).to_bytes(4, "big") + text_of(SSH_PUBLIC) + text_of(b"abcdabcd" + SSH_PUBLIC + text_of(b"\3" * 64))
#: Private keys in all the encodings that are known; and what looks alike but is public, garbage, or of wrong nested lengths.
PRIVATE = [RSA, PKCS8, SEALED, CURVE, OPENSSH]
OTHER = [seq(seq(OID, der(5, b"")), der(3, b"\0" + seq(der(2, b"\1" * 129), der(2, b"\1\0\1")))), seq(der(2, b"\1" * 129), der(2, b"\1\0\1")), SSH_PUBLIC, text_of(b"ssh-rsa") + text_of(b"\1\0\1") + text_of(b"\1" * 129),
         b"openssh-key-v1\0" + b"garbage" * 20, OPENSSH + b"x", OPENSSH[:-1], PKCS8[:-1] + b"", RSA[:3] + RSA[4:] + b"\0", seq(der(2, b"\0"), seq(OID, der(5, b"")), der(4, RSA[:-1])), seq(der(2, b"\0"), der(2, b"\1" * 129), der(2, b"\1\0\1"))]


def test_base_spans(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    t = pq.read_table(path, columns=["doc_id", "text"])
    want = {d: brute(x) for d, x in zip(*(c.to_pylist() for c in t.columns), strict=True)}
    got = secrets.find_secrets(spark.read.parquet(path)).collect()
    assert len(got) == len(want)
    assert any(sum(w[0]) for w in want.values())
    for r in got:
        assert ((r.n_assign, r.n_access, r.n_hex), r.base_sha256) == want[r.doc_id][:2]
        assert set(filter(None, want[r.doc_id][2].split(","))) <= set(r.spans.split(","))


def test_edges(spark):
    tok = ".".join(base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=") for x in ({"alg": "HS256"}, {"sub": 1})) + ".c2ln"
    not_tok = "eyJub3QiOjF9.eyJub3QiOjF9.x"
    b64 = base64.b64encode(KEY).decode()
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(b64[i : i + 64] for i in range(0, len(b64), 64)) + "\n-----END RSA PRIVATE KEY-----"
    texts = [None, "", "é token=\"abcdefgh\" PASSWORD : short", "ſecret=abcdefgh toKen=abcdefgh", f"see {tok} and {not_tok}", f"x {b64} y", f"é {pem}",
             "key " + KEY.hex(), "A" * 60, "f" * 24 + "g" + "0" * 23, "AKIA" + "A" * 15 + " AKIA" + "B" * 16, "a" * 200000]
    got = {r.doc_id: r for r in secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for d, t in enumerate(texts):
        assert ((got[d].n_assign, got[d].n_access, got[d].n_hex), got[d].base_sha256) == brute(t)[:2], d
    assert f"jwt:4:{4 + len(tok)}" in got[4].spans and "eyJub3Q" not in got[4].spans and got[4].spans.count("jwt") == 1
    assert got[5].spans.endswith(f"key:2:{2 + len(b64)}")
    assert "pem:2:" in got[6].spans
    assert got[7].spans == f"hex:4:{4 + 2 * len(KEY)},key:4:{4 + 2 * len(KEY)}"
    assert got[8].spans == "" and got[8].n_confirmed == 0
    assert secrets.find_secrets(spark.createDataFrame([], "doc_id long, text string, spans int")).count() == 0


def test_only_private_keys_of_right_nested_lengths(spark):
    rows, want = [], {}
    for k, raw in enumerate(PRIVATE + OTHER):
        forms = [base64.b64encode(raw).decode(), base64.urlsafe_b64encode(raw).decode(), raw.hex().upper(), raw.hex(), "".join(c.upper() if i % 3 else c for i, c in enumerate(raw.hex()))]
        for f, form in enumerate(forms):
            rows.append((100 * k + f, f"é {form} x"))
            want[100 * k + f] = k < len(PRIVATE)
    got = {r.doc_id: r.spans for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, t in rows:
        assert (f"key:2:{len(t) - 2}" in got[d].split(",")) == want[d] and got[d].count("key:") == want[d], (d, got[d])


def test_armour(spark):
    b = base64.b64encode(RSA).decode()
    lines = "\n".join(b[i : i + 64] for i in range(0, len(b), 64))
    wrap = lambda name, body: f"-----BEGIN {name}-----\n{body}\n-----END {name}-----"
    sealed = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123456789ABCDEF0123456789ABCDEF\n\n" + base64.b64encode(b"\4" * 640).decode()
    good = [wrap("RSA PRIVATE KEY", lines), wrap("RSA PRIVATE KEY", lines).replace("\n", "\\n"), wrap("RSA PRIVATE KEY", sealed), "-----BEGIN X-----\n" + wrap("PRIVATE KEY", base64.b64encode(PKCS8).decode())]
    bad = [wrap("PUBLIC KEY", base64.b64encode(OTHER[0]).decode()), wrap("RSA PRIVATE KEY", base64.b64encode(b"\4" * 640).decode()), "-----BEGIN A-----" * 3000, wrap("RSA PRIVATE KEY", lines).replace("END RSA", "END DSA")]
    rows = list(enumerate(f"é {t} !" for t in good + bad))
    got = {r.doc_id: r.spans for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, t in rows:
        pems = [x for x in got[k].split(",") if x.startswith("pem")]
        assert pems == ([f"pem:{t.rindex('-----BEGIN')}:{len(t) - 2}"] if k < len(good) else []), (k, pems)


def test_a_failing_candidate_hides_no_token(spark):
    tok = ".".join(base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=") for x in ({"alg": "HS256"}, {"sub": 1})) + ".c2ln"
    docs = spark.createDataFrame([(1, f"eyJx.{tok}"), (1, f"eyJx.eyJy.{tok} {tok}"), (None, "eyJ." * 20000)], "doc_id long, text string")
    assert sorted(r.spans for r in secrets.find_secrets(docs).collect()) == sorted([f"jwt:5:{5 + len(tok)}", f"jwt:10:{10 + len(tok)},jwt:{11 + len(tok)}:{11 + 2 * len(tok)}", ""])


def test_keys_in_any_surroundings(spark):
    """A key is found by its own lengths: after 0x, in lines without armour, with colons, and with letters, slashes or dashes in front; no public key is."""
    rows, want = [], {}
    for k, raw in enumerate(PRIVATE + OTHER):
        b, h = base64.b64encode(raw).decode(), raw.hex()
        lines = lambda x, n, end="\n": end.join(x[i : i + n] for i in range(0, len(x), n))
        forms = [(b, "/", ""), (b, "-", ""), (b, "key_", " x"), (b, "path/to/", "\""), (lines(b, 64), "é ", "\n."), (lines(b, 76, "\r\n  "), "", ""), (lines(b, 64, "\\n"), "'", "'"), (h, "0x", ""), (h, "key_", ""), (lines(h, 2, ":"), "", "!"),
                 (lines(lines(h, 2, ":"), 45, "\n    "), "", ""), (lines(h, 64), "", "\n"), (h.upper(), "/", "g"), (b, "A1b2/", "")]
        for f, (form, before, after) in enumerate(forms):
            rows.append((100 * k + f, before + form + after))
            want[100 * k + f] = f"key:{len(before)}:{len(before) + len(form)}" if k < len(PRIVATE) else None
    got = {r.doc_id: r.spans for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, t in rows:
        keys = [x for x in got[d].split(",") if x.startswith("key")]
        assert keys == ([want[d]] if want[d] else []), (d, t[:40], keys)


def test_many_starts_that_are_no_keys(spark):
    """Texts full of beginnings cost no more than their length allows."""
    texts = ["MIICXQIBAAKBgQ" * 40_000, "3082025d020100" * 40_000, "30:82:02:5d:02:01:00:" * 20_000, "b3BlbnNzaC1rZXktdjEA" * 20_000, "MIIC\n" * 60_000]
    got = secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(r.n_confirmed == 0 for r in got)
