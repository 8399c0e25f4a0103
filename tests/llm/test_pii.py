import hashlib
import re
import time

from concord.llm.pii import find_pii, labelled, op2_pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def ok(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": all(int(x) <= 255 for x in m.split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def brute(t):
    return ",".join(
        f"{k}:{s}:{e}"
        for s, _, k, e in sorted((m.start(), i, k, m.end()) for i, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, t or "", re.ASCII) if ok(k, m[0]))
    )


TEXTS = [
    None, "", "a@b.c_d@e.f g@h i@j.k.", "mail x.y+z@ex-1.org, y@@z.com a@b..c.d", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.255.0 1.2.3", "4111 1111 1111 1111 and 4111-1111 1111 1112",
    "😀 +1 (389) 555-5010 call; +12 +1.....2 +123456789012345678", "5  4111111111111111 5 4111111111111111", "call 4111111111111111-", "a" * 30_000, "1." * 20_000, "x@" + "a." * 20_000, "1 " * 30_000 + "9",
    "+1" * 3000, "DE89 3704 0044 0532 0130 00 bank account GB82WEST12345698765432", "my ssn is 123-45-6789; 000-12-3456", "a@b.c a@b.c",
    "ssn " + "123-45-6789 " * 3, "é😀" * 600 + " ssn " + "😀" * 30 + " 123-45-6789 a@b.c " + "x" * 600,
]


def base(r, spans):
    return ",".join(x for x in spans.split(",") if x.split(":")[0] in BASE)


def test_small(docs):
    got = find_pii(docs(TEXTS, ["pii", "spans", "_text"])).orderBy("doc_id")
    got = [r[0] for r in got.select(labelled(got["pii"])).collect()]
    for t, g in zip(TEXTS, got, strict=True):
        assert base(None, g) == brute(t), t
    assert "iban:0:27" in got[14] and got[14].count("iban") == 2
    assert got[15].count("ssn") == 1 and got[17].count("ssn") == 3 and got[18].count("ssn") == 1
    assert find_pii(docs(["x"]).limit(0)).count() == 0
    kept = find_pii(docs(["a@b.c"], ["_text", "_m_email", "_pii_text", "pii"]))
    assert kept.first()._text == kept.first()._m_email == kept.first()._pii_text == "x" and len(kept.first().pii) == 1


def test_many_matches(docs):
    """100,000 matches in one text take seconds."""
    text = "host 10.0.0.1 mail a@b.c é " * 50_000
    began = time.time()
    d = find_pii(docs([text, text[:-1]]))
    got = [r[0] for r in d.orderBy("doc_id").select(labelled(d["pii"])).collect()]
    assert time.time() - began < 40
    assert got == [brute(text), brute(text[:-1])]


def test_query(spark, small):
    t = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    out = op2_pii(spark, small).collect()
    assert len(out) == len(t)
    for r in out:
        want = brute(t[r.doc_id])
        assert base(r, r.spans) == want
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k + ":") for x in want.split(",")) for k in BASE]
