import base64
import hashlib
import random
import re

from textlode.llm import secrets


def scan(text, start, ok):
    """Longest stretch of characters that meet ``ok``."""
    end = start
    while end < len(text) and ok(text[end]):
        end += 1
    return end


def assign_at(text, i):
    """A hand-written matcher for one place: (end, start of the value) or None."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text[i : i + 8])
    for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
        if not low.startswith(name):
            continue
        j = i + len(name)
        for quote in ([1, 0] if text[j : j + 1] in ('"', "'") and text[j : j + 1] else [0]):
            k = scan(text, j + quote, lambda c: c == " ")
            if k < len(text) and text[k] in ":=":
                k = scan(text, k + 1, lambda c: c == " ")
                k += k < len(text) and text[k] in "\"'"
                end = scan(text, k, lambda c: re.match("[A-Za-z0-9+/_.=-]", c) is not None)
                if end > k:
                    return end, k
    return None


def brute(text):
    text, out, i = text or "", [], 0
    while i < len(text):
        found = assign_at(text, i)
        if found and found[0] - found[1] >= 12:
            out.append((i, found[0], "assign"))
        i = found[0] if found else i + 1
    i = 0
    while i < len(text):
        end = scan(text, i + 4, lambda c: "A" <= c <= "Z" or "0" <= c <= "9") if text[i : i + 4] == "AKIA" else i
        if end > i + 4 and end - i >= 18:
            out.append((i, end, "access"))
        i = end if end > i + 4 else i + 1
    i = 0
    while i < len(text):
        end = scan(text, i, lambda c: c in "0123456789abcdef")
        if end - i >= 16:
            out.append((i, end, "hex"))
        i = max(end, i + 1)
    return sorted(out, key=lambda x: (x[0], secrets.KINDS.index(x[2])))


def texts():
    rnd = random.Random(8)
    parts = ["password", "Token", "SECRET", "api_key", "ApiKey", "=", ":", " ", '"', "'", "abcdef0123456789", "AKIA", "ABCDEFGHIJKLMN12", "short", "x", "é", "\n", "ſecret", "-", "."]
    return ["", None, "token=token=abcdefghijklmnop", "secret: token token=abcdefghijklm", "AKIA" * 6, "f" * 5000, "password" * 2000] + [
        "".join(rnd.choice(parts) for _ in range(rnd.randrange(40))) for _ in range(600)
    ]


def test_base_spans_against_a_scanner():
    for t in texts():
        assert secrets.spans_of(t)[0] == brute(t), t


def test_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(None, "token = abcdef0123456789", "y")] * 2
    got = secrets.digests(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t, _ in rows[:-2]:
        base = brute(t)
        assert by[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in base).encode()).hexdigest()
        kinds = [k for *_, k in base]
        assert [by[i].n_assign, by[i].n_access, by[i].n_hex] == [kinds.count(k) for k in secrets.KINDS[:3]]
        assert set(f"{k}:{s}:{e}" for s, e, k in base) <= set(by[i].spans.split(","))
    assert by[None].spans == "assign:0:24,hex:8:24"  # a token of 16 characters is not measured
    assert secrets.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_novelty_tells_keys_from_names(spark):
    rnd = random.Random(2)
    key = base64.b64encode(rnd.randbytes(36)).decode()
    code = f"client credential for the service\nauthorize('{key}')\n"
    assert [(s, e) for s, e, k in secrets.spans_of(code)[1] if k == "novel"] == [(code.index(key), code.index(key) + len(key))]
    for plain in ("credential_manager_default_settings_v2 = 1", "private /usr/local/share/application1/config/module2", "auth zzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzz1"):
        assert secrets.spans_of(plain)[1] == []
    assert secrets.spans_of(f"nothing near\n{'word ' * 40}{key}")[1] == []
    repeated = f"session {key} again {key}"
    assert secrets.marginal_bytes(repeated, 8, 8 + len(key)) > 0.8 * len(key)  # copies do not explain each other
    found = secrets.scan(spark.createDataFrame([(1, code), (2, None)], "doc_id long, text string")).collect()
    assert [r.value for r in found] == [key] and found[0].novelty >= secrets.NOVELTY


def test_planted_keys_recall_and_precision():
    """Keys of several alphabets, half of them inside base spans, among names, paths and words."""
    rnd = random.Random(12)
    words = secrets.IDENTIFIERS.decode().split()
    names = [w for w in words if w.isalpha() and len(w) > 3]
    hits = reported = right = planted = 0
    for i in range(400):
        kind = i % 4
        raw = rnd.randbytes(30)
        key = [base64.b64encode(raw).decode(), base64.b32encode(raw).decode().rstrip("="), "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=32)), base64.urlsafe_b64encode(raw).decode()][kind]
        plain = "_".join(rnd.sample(names, 4))
        path = "/" + "/".join(rnd.sample(names, 4))
        text = f"{plain} = load('{path}')\n# private session\n" + (f"token = '{key}'\n" if i % 2 else f"client.sign(\"{key}\")\n")
        found = [(s, e) for s, e, k in secrets.spans_of(text)[1] if k == "novel"]
        at = text.index(key)
        planted += 1
        reported += len(found)
        right += (at, at + len(key)) in found
        hits += any(s < at + len(key) and at < e for s, e in found)
    print("planted keys found", hits / planted, "of what is reported, keys", right / reported)
    assert hits / planted > 0.99 and right / reported > 0.85  # half of the other tokens are made of names that are rare in so short a text


def test_a_very_long_text():
    text = "session " + "lorem ipsum dolor " * 200_000 + "token='abcdefghijkl'" + " x" * 1_000_000
    assert [k for *_, k in secrets.spans_of(text)[1]] == ["assign"]


def test_keys_of_any_alphabet_and_keys_written_twice():
    rnd = random.Random(5)
    novel = lambda text: [text[s:e] for s, e, k in secrets.spans_of(text)[1] if k == "novel"]
    low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    for letters in (low, up, up + "234567", low + "0123456789"):
        for n in (20, 32, 40):
            for _ in range(20):
                key = "".join(rnd.choices(letters, k=n))
                assert novel(f"client credential\nauthorize('{key}')\n") == [key]
                assert novel(f"session '{key}' again '{key}' private") == [key, key]
    for plain in ("private_repository_connection_handler_factory", "auth /var/lib/application/config/session/storage", "credential_provider_update_timestamp"):
        assert novel(f"auth {plain}") == []
