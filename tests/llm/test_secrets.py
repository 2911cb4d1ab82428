import hashlib
import random
import re
import string

from scoreforge.llm import secrets as S

from .conftest import ODD


def brute_base(text):
    """The contract's patterns, taken literally."""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text,
                         re.I | re.A):
        if len(m[2]) >= 6:
            out.append(("assign", *m.span()))
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return out


def test_base_spans_match_the_patterns_literally():
    random.seed(0)
    parts = ["password", "Secret", "api_key", "APIKEY", "token", '"', "'", " ", "=", ":", "abc", "abcdef0123456789", "AKIA",
             "ABCDEF0123456789", "deadbeefdeadbeefdeadbeef", "ſecret=", "K", "\n", "é"]
    for _ in range(400):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 14)))
        names = [(S.KINDS[k], a, b) for k, a, b in S.base_spans(text)]
        assert sorted(names) == sorted(brute_base(text))


def test_novel_strings_are_reported_and_known_ones_not():
    random.seed(1)
    fresh = "".join(random.choices(string.ascii_letters + string.digits, k=32))
    text = f"the auth header was {fresh} in this log"
    base, novel = S.scan(text)
    assert base == [] and [text[a:b] for _, a, b in novel] == [fresh]
    assert S.scan(f"the value was {fresh} in this log") == ([], [])              # no sensitive context
    assert S.scan("the auth header was your_api_key_here_1234567890 here")[1] == []   # known to the dictionary
    seen = f"{fresh} and again auth: {fresh}"
    assert S.marginal_bytes(seen[:40], fresh, "") < S.marginal_bytes("and again auth: ", fresh, "")


def test_keys_over_small_alphabets_are_reported_at_every_length():
    random.seed(6)
    for alphabet in ("0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", string.ascii_letters + string.digits + "+/"):
        for n in (32, 96, 160, 512):
            for _ in range(20):
                key = "".join(random.choices(alphabet, k=n))
                text = f"the private_key {key} was used"
                assert [text[a:b] for _, a, b in S.scan(text)[1]] == [key]
    for known in ("a" * 60 + "1", "your_api_key_here_1234567890", "0000000000000000000000000000000a"):
        assert S.scan(f"the private_key {known} was used")[1] == []


def test_every_line_of_a_key_is_reported():
    random.seed(7)
    lines = ["".join(random.choices(string.ascii_letters + string.digits + "+/", k=64)) for _ in range(24)] + ["Zm9v+a=="]
    for left, right in (("-----BEGIN RSA PRIVATE KEY-----\n", "\n-----END RSA PRIVATE KEY-----"),
                        ("-----BEGIN PRIVATE KEY-----\\n", "\\n-----END PRIVATE KEY-----")):
        clean = S.redacted("see " + left + ("\n" if "\\" not in left else "\\n").join(lines) + right + " end")
        assert clean.startswith("see -----BEGIN") and clean.endswith(" end") and not any(line in clean for line in lines)
    body = "session key:\n  " + "\n  ".join(lines[:-1]) + "\nand plain words follow"
    clean = S.redacted(body)
    assert not any(line in clean for line in lines[:-1]) and clean.endswith("and plain words follow")


def test_parts_beside_a_base_span_are_reported():
    random.seed(8)
    tail = "".join(random.choices(string.ascii_uppercase + "+/", k=30))
    text = f"auth {'9f86d081884c7d659a2feaa0c55ad015'}{tail} end"
    base, novel = S.scan(text)
    assert [text[a:b] for _, a, b in base] == ["9f86d081884c7d659a2feaa0c55ad015"]
    assert [text[a:b] for _, a, b in novel] == [tail]


def test_report_and_redaction(spark, make_docs):
    text = 'a token = "4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e" b'
    rows = {r["doc_id"]: r["secrets"] for r in S.scan_secrets(make_docs([*ODD, (50, text)])).collect()}
    spans = [(k, a, b) for k, a, b in brute_base(text)]
    digest = ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: s[1]))
    assert rows[50]["base_sha256"] == hashlib.sha256(digest.encode()).hexdigest()
    assert (rows[50]["n_assign"], rows[50]["n_hex"], rows[50]["n_access"]) == (1, 1, 0)
    assert rows[1]["base_sha256"] == rows[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    clean = {r["doc_id"]: r["text"] for r in S.redact_secrets(make_docs([*ODD, (50, text)])).collect()}
    assert clean[50] == 'a [removed]" b' and clean[1] is None and clean[4] == "plain words in a row"
    assert S.scan_secrets(make_docs([])).count() == 0


def test_long_and_open_key_blocks_take_linear_time():
    import time
    n = 100_000
    texts = ["-----BEGIN PRIVATE KEY-----" + " " * n, "-----BEGIN RSA PRIVATE KEY-----\n" + "A1b2" * n,
             "-----BEGIN PRIVATE KEY-----\n" * (n // 20), ("-----BEGIN PRIVATE KEY-----" + " " * 50) * 2000 + "-----END",
             "-----BEGIN PRIVATE KEY-----\n" + "x: y\n" * (n // 5) + "-----END", "secret " + "a1b2c3d4e5f6g7h8 " * (n // 17),
             "token: abcdefgh" + "\n" * n + "abcdef0123456789abcd", "key " + "ab12" * n]
    for text in texts:
        began = time.time()
        S.scan(text)
        assert time.time() - began < 1


def test_key_block_bodies():
    head, foot = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    text = f"x {head}\nProc-Type: 4,ENCRYPTED\nDEK-Info: A,B\n\nMIIEabc\nDEF+/==\n{foot} y"
    (a, b), = S.key_blocks(text)
    assert text[a:b] == "MIIEabc\nDEF+/=="
    assert S.key_blocks(f"{head}\nMIIE") == [] and S.key_blocks(f"{head}\n{foot}") == []
    assert S.key_blocks(f"{head}\nnot a body!\n{foot}") == []
    two = f"{head}\nAAAA\n{foot}\n{head}\nBBBB\n{foot}"
    assert [two[a:b] for a, b in S.key_blocks(two)] == ["AAAA", "BBBB"]
