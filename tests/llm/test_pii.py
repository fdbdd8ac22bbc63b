import hashlib
import random
import re

from textlode.llm import pii


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute(text):
    text = text or ""
    d = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(d(m)) <= 19 and luhn(d(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(d(m)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, text) if ok(m.group())]


def with_check(d):
    return next(d + c for c in "0123456789" if luhn(d + c))


def texts():
    rnd = random.Random(5)
    card = with_check("453201511283036")
    out = [
        "", None, "a@b.c_d@e.f x@y", "mail é.x+y@h-1.example.com, 1.2.3.4.5.6.7.8 and 0000255.1.1.256 9.9.9.9", f"{card} {card[:4]}-{card[4:8]} {card[8:]}",
        "12 " + card, card + "1", "+1 (168) 555-5254 +12 +123456789012345678 +1 2 3 4 5 6 7 8", "9" * 3000, "1 " * 3000, "a" * 20000, "a." * 5000 + "@x.y",
        "1." * 4000, "+1" * 2000, f"🙂 {with_check('37828224631000')} amex é {with_check('37828224631000')}", "IBAN GB82 WEST 1234 5698 7654 32 or GB82WEST12345698765433",
        "ssn 078-05-1120, 123-45-6789-0", "a@b.c " * 300,
    ]
    pieces = ["@", ".", "+", "-", " ", "(", ")", "a", "b.c", "12", "255", "1.2.3.4", card, "5555", "x@y.z", "é", "\n", "_"]
    return out + ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(60))) for _ in range(400)] + out[4:7]


def test_base_spans_against_brute_force(spark):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in pii.digests(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, base int")).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want = brute(t)
        r = got[i]
        written = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert ",".join(x for x in r.spans.split(",") if x.split(":")[0] in pii.BASE) == written, t
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for k, *_ in want) for n in pii.BASE]


def test_added_kinds(spark):
    rows = [(1, "IBAN GB82 WEST 1234 5698 7654 32 here"), (2, "GB82 WEST 1234 5698 7654 33"), (3, "ssn 078-05-1120"), (4, "part 078-05-1120")]
    got = {r.doc_id: r.spans for r in pii.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "iban:5:32", 2: "", 3: "ssn:4:15", 4: ""}


def test_mask(spark):
    rows = [(1, "write é@ to a@b.com or 1.2.3.4!"), (2, None), (3, ""), (4, "+49 1.2.3.4 5")]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, base string")
    got = {r.doc_id: r for r in pii.mask(docs).collect()}
    assert got[1].text == "write é@ to <email> or <ip>!"
    assert got[2].text is None and got[3].text == "" and got[1].base == "k"
    assert got[4].text == "<phone>" or got[4].text.startswith("+49 <ip>")


def test_empty_table(spark):
    assert pii.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_mask(text):
    """Spans of all kinds by start, longer ones first; those that overlap one before add nothing but their end."""
    if text is None:
        return None
    spans = [(s, -e, k) for k, s, e in brute(text)]
    for kind in ("iban", "card15", "ssn"):
        for m in re.finditer(PLAIN[kind], text):
            digits = re.sub("[^0-9]", "", m.group())
            around = text[max(0, m.start() - 40) : m.end() + 40].lower()
            near = re.search(pii.CONTEXT[kind], around) is not None
            if (kind == "ssn" and near) or (kind == "card15" and near and luhn(digits)) or (kind == "iban" and iban(m.group())):
                spans.append((m.start(), -m.end(), kind))
    out, at = [], 0
    for start, end, kind in sorted(spans, key=lambda x: x[:2]):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, -end)
    return "".join(out) + text[at:]


PLAIN = {
    "iban": r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Z0-9])",
    "card15": r"(?<![0-9])3[47](?:[\x20-]?[0-9]){13}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}


def iban(value):
    plain = value.replace(" ", "")
    turned = "".join(str(int(c, 36)) for c in plain[4:] + plain[:4])
    return 15 <= len(plain) <= 34 and int(turned) % 97 == 1


def test_mask_against_brute_force(spark):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r.text for r in pii.mask(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, base int")).collect()}
    for i, t in rows:
        assert got[i] == brute_mask(t), t


def test_many_matches_in_one_text(spark):
    import time

    docs = spark.createDataFrame([(1, "write to a.b@c.de, ssn 078-05-1120 é🙂 now " * 50_000)], "doc_id long, text string")
    began = time.perf_counter()
    r = pii.digests(docs).collect()[0]
    assert r.n_email == 50_000 and r.spans.count("ssn:") == 50_000 and set(r.scores.split(",")) == {"1.1", "0.5"}
    assert pii.mask(docs).collect()[0].text == "write to <email>, ssn <ssn> é🙂 now " * 50_000
    assert time.perf_counter() - began < 120
