"""Secret scans: fixed patterns, and dictionary-primed zstandard novelty.

Three base patterns mark assignments, access keys and long hex runs.  Beyond
them, a mixed string of letters and digits after a sensitive word is a candidate.
Its novelty is the marginal number of compressed bytes: the size
of zstandard's output for surroundings plus candidate, less that for the surroundings
alone, the compressor being primed with a dictionary of identifiers and the
code around it.  A candidate that costs about what random symbols of its own alphabet
cost cannot be told from its context or from common names, and is reported as ``novel``.
The next line of a reported string is a candidate too, and the body of a private key block is
reported whole.  Of a candidate that base spans cover in part, the rest is reported.

Defined cases: null text reads as empty and has no spans; spans of different
kinds may overlap, but a novel span never overlaps another; copies and repeated rows
are scanned alike; whole texts are scanned.
"""

from __future__ import annotations

import hashlib
import re
from math import log2

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

# fixed values: the base patterns and the length each match must have
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Words after which a string is sensitive.
CONTEXT = re.compile(r"auth|bearer|credential|private|passphrase|pass|pwd|secret|token|key|cookie|session|signature|salt",
                     re.ASCII | re.IGNORECASE)
CONTEXT_WORDS = ("auth", "bearer", "credential", "private", "pass", "pwd", "secret", "token", "key", "cookie", "session",
                 "signature", "salt")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: What may stand between the lines of one string.
JOIN = re.compile(r"""[\s"'\\+,>#*]*(?:\\[nr][\s"'\\+,>#*]*)*""")
#: Characters that may stand between two lines of one string.
JOIN_REACH = 4096
#: Ends of a private key block, header lines in it, and what its body is made of.
BEGIN = re.compile(r"-----BEGIN [A-Z0-9 ]{0,64}PRIVATE KEY[A-Z ]{0,64}-----")
END = "-----END"
HEADER = re.compile(r"[A-Za-z-]{1,64}:[^\n]*\n")
BODY = re.compile(r"[A-Za-z0-9+/=\s\\]*")
SPACE = re.compile(r"\s*")
#: Identifiers and code that prime the compressor, most likely last.
IDENTIFIERS = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz 0123456789 1234567890 0000000000000000 aaaaaaaaaaaaaaaa "
    b"xxxxxxxxxxxxxxxxxxxx example placeholder changeme yourkeyhere your_api_key_here insert_token_here test_value sample "
    b"default undefined localhost 127.0.0.1 https://www. http:// .example.com/ application/json text/html utf-8 "
    b"function return import export const public static void string integer boolean null true false class self this "
    b"username user_name user_id client_id client_secret account_id access_key access_key_id secret_access_key "
    b"private_key public_key session_id session_token refresh_token access_token id_token auth_token authorization "
    b"Authorization: Bearer Basic credential credentials password passphrase passwd pwd apikey api_key api-key "
    b"cookie signature salt nonce database_url connection_string configuration environment settings config "
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, in code points."""
    spans = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        spans += [(0, *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [(1, *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(2, *m.span()) for m in HEX.finditer(text)]
    return spans


def marginal_bytes(before: str, candidate: str, after: str) -> int:
    """Compressed bytes that ``candidate`` adds to its surroundings, identifiers being known."""
    dictionary = zstandard.ZstdCompressionDict(
        IDENTIFIERS + (after + "\n" + before).encode("utf-8", "replace"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    press = zstandard.ZstdCompressor(level=9, dict_data=dictionary, write_content_size=False, write_dict_id=False)
    plain = before[-32:].encode("utf-8", "replace")
    return len(press.compress(plain + candidate.encode())) - len(press.compress(plain))


def costly(cost: int, candidate: str, least: float = 0.7) -> bool:
    """Whether ``cost`` bytes are what random symbols of the candidate's alphabet (16 at the least) would take."""
    return cost >= min(least, log2(max(16, len(set(candidate)))) / 8) * len(candidate)


def _mixed(part: str) -> bool:
    return any(map(str.isdigit, part)) and any(map(str.isalpha, part))


def _uncovered(text: str, a: int, b: int, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Parts of [a, b) outside ``taken``; beside an assignment only those that would be candidates alone."""
    parts = _rest(a, b, taken)
    values = {e for k, x, y in taken if k for e in (x, y)}
    return [(x, y) for x, y in parts if x in values or y in values or (y - x >= 16 and _mixed(text[x:y]))]


def key_blocks(text: str) -> list[tuple[int, int]]:
    """Bodies of private key blocks, without header lines and outer white space, in one pass over the text.

    A block ends at the next end line; one without an end, or with other characters in its body, is no block.
    """
    blocks = []
    if "PRIVATE KEY" not in text:
        return blocks
    at, end = 0, -1
    while (m := BEGIN.search(text, at)) is not None:
        at = m.end()
        if end < at:
            end = text.find(END, at)               # looked for once, however many blocks begin before it
            if end < 0:
                break
        a = SPACE.match(text, at, end).end()
        while (h := HEADER.match(text, a, end)) is not None:
            a = SPACE.match(text, h.end(), end).end()
        b = a + len(text[a:end].rstrip())
        if a < b and BODY.match(text, a, b).end() == b:
            blocks.append((a, b))
            at = end
    return blocks


def novel_spans(text: str, taken: list[tuple[int, int, int]], around: int = 160, reach: int = 48,
                least: float = 0.7) -> list[tuple[int, int, int]]:
    """Incompressible candidates within ``reach`` characters after a sensitive word, or on the line after one reported."""
    low = text.lower()
    if not any(w in low for w in CONTEXT_WORDS):
        return []
    blocks = key_blocks(text)
    spans = [(3, x, y) for a, b in blocks for x, y in _rest(a, b, taken)]
    busy = sorted(taken, key=lambda s: s[1:])
    at, last = 0, -1                           # last: where the string reported before ends
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        found = m.group()
        if any(a < y and b > x for x, y in blocks):
            continue
        while at < len(busy) and busy[at][2] <= a:
            last = max(last, busy[at][2]) if busy[at][0] else last
            at += 1
        # a line joined to a reported one is near it: what stands between is bounded
        follows = 0 <= last <= a <= last + JOIN_REACH and JOIN.fullmatch(text, last, a) is not None
        if not (_mixed(found) or follows) or not (follows or CONTEXT.search(text, max(0, a - reach), a)):
            continue
        touched = [s for s in busy[at:] if s[1] < b and s[2] > a] if at < len(busy) and busy[at][1] < b else []
        parts = _uncovered(text, a, b, touched) if touched else [(a, b)]
        if parts and costly(marginal_bytes(text[max(0, a - around):a], found, text[b:b + around]), found, least):
            spans += [(3, x, y) for x, y in parts]
            last = b
    return sorted(spans)


def _rest(a: int, b: int, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """[a, b) without the base spans inside it."""
    parts, at = [], a
    for x, y in sorted((x, y) for _, x, y in taken if x < b and y > a):
        if x > at:
            parts.append((at, x))
        at = max(at, y)
    return parts + [(at, b)] if at < b else parts


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and novel spans of a whole text, each by start, then kind."""
    base = sorted(base_spans(text), key=lambda s: (s[1], s[0]))
    return base, novel_spans(text, base)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], s[0])))


def redacted(text: str, mark: str = "[removed]") -> str:
    """The text with every span (overlapping ones together) replaced by ``mark``."""
    base, novel = scan(text)
    out, at = [], 0
    for a, b in sorted((a, b) for _, a, b in base + novel):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


REPORT = "struct<n_assign: long, n_access: long, n_hex: long, n_novel: long, base_sha256: string, spans: string>"
_REPORT = pa.struct([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_novel", pa.int64()),
                     ("base_sha256", pa.string()), ("spans", pa.string())])


def _report(text: str) -> dict:
    base, novel = scan(text)
    kinds = [k for k, _, _ in base]
    return {"n_assign": kinds.count(0), "n_access": kinds.count(1), "n_hex": kinds.count(2), "n_novel": len(novel),
            "base_sha256": hashlib.sha256(written(base).encode()).hexdigest(), "spans": written(base + novel)}


def scan_secrets(docs: DataFrame, text: str = "text", to: str = "secrets") -> DataFrame:
    """``docs`` with a struct of counts and spans of each whole text; row-local, no shuffle."""
    udf = F.arrow_udf(lambda t: pa.array([_report(x) for x in texts(t)], _REPORT), REPORT)
    return docs.withColumn(to, udf(F.col(text).cast("string")))


def redact_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced; null stays null, texts without one are unchanged."""
    udf = F.arrow_udf(lambda t: pa.array([None if x is None else redacted(x) for x in t.to_pylist()], pa.string()), "string")
    return docs.withColumn(text, udf(F.col(text).cast("string")))
