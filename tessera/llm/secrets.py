"""Secret scans: known shapes, and random strings by token efficiency.

Known shapes (kinds ``assign``, ``access`` and ``hex``) are patterns. Beyond
them, a run of key-like characters that a public byte-pair vocabulary can only
write with few characters a token is no word of any language: it is reported
as kind ``random``, unless it overlaps a known shape or is a known digest, a
UUID or a number. Identifiers, which are letters and numbers between separators,
are judged by their longer runs of letters alone and by a stricter ratio, so
that invented words pass and keys of letters do not.

Spans are code points with an exclusive end; for ``assign`` the span is the
whole assignment. Defined results: a null or empty text has no span; each row
has its own result, repeated or not; spans that start together (ties) go by
kind as listed. Very long texts and runs are scanned whole, in time that grows
with their length; a run is encoded in pieces of ``PIECE`` characters. An empty
table gives no row. Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Fixed values of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"\p{L}+|\p{N}+|[^\p{L}\p{N}]+"
#: Random strings have at least so many characters, and at most so many a token.
MIN_CHARS, MAX_RATIO = 20, 2.1
#: Letters of an identifier that are judged, and their characters a token at most.
MIN_LETTERS, LETTER_RATIO = 16, 1.9
#: Characters that are encoded at once.
PIECE = 4096

_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_-]{{{MIN_CHARS},}}={{0,2}}")
_DIGEST = re.compile(r"[0-9a-fA-F]+")
_DIGEST_CHARS = {32, 40, 48, 56, 64, 96, 128}
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_SEPARATOR = re.compile(r"[_/+=-]+")
_HEX_RUN = bytes(0x78 if chr(b) in "0123456789abcdef" else 0x20 for b in range(256))
_KEY_RUN = bytes(0x78 if chr(b).isalnum() and b < 128 or chr(b) in "+/_-" else 0x20 for b in range(256))


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """A tiktoken vocabulary file. Read where the plan is made and shipped: its size is fixed."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def known_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the known shapes. Cheap byte tests first: most texts have none."""
    data = text.encode("utf-8", "surrogatepass")
    low = data.lower()
    found = []
    if b"passw" in low or b"secret" in low or b"token" in low or b"api" in low:
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in data:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if b"x" * 24 in data.translate(_HEX_RUN):
        found += [(*m.span(), "hex") for m in re.finditer("[0-9a-f]{24,}", text)]
    return found


def is_known(run: str) -> bool:
    """Whether a key-like run is a digest, a UUID, or has no letter or no sign of a key to judge."""
    return bool(_DIGEST.fullmatch(run) and len(run) in _DIGEST_CHARS or _UUID.fullmatch(run)) or not any(map(str.isalpha, run))


def judged(run: str) -> tuple[list[str], float]:
    """What of a run is judged, and by how many characters a token at most."""
    letters = []
    for part in _SEPARATOR.split(run):
        own = part.rstrip("0123456789")
        if own and not own.isalpha() or own and len(part) - len(own) > 6:
            return [run], MAX_RATIO
        letters.append(own)
    return [x for x in letters if len(x) >= MIN_LETTERS], LETTER_RATIO


def tokens_in(text: str, encode) -> int:
    return sum(len(encode(text[at : at + PIECE])) for at in range(0, len(text), PIECE))


def is_random(run: str, encode) -> bool:
    if is_known(run):
        return False
    parts, ratio = judged(run)
    return any(len(x) <= ratio * tokens_in(x, encode) for x in parts)


def random_spans(text: str, encode, known: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """Spans of runs that the vocabulary writes with few characters a token."""
    if b"x" * MIN_CHARS not in text.encode("utf-8", "surrogatepass").translate(_KEY_RUN):
        return
    spans, at, reach = sorted(known), 0, -1
    for m in _CANDIDATE.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            reach = max(reach, spans[at][1])
            at += 1
        if reach <= m.start() and is_random(m[0], encode):
            yield *m.span(), "random"


def listed(spans: list[tuple[int, int, str]]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    spans = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{kind}:{lo}:{hi}" for lo, hi, kind in spans)


def _scan(shipped, pattern: str):
    def run(batches):
        import tiktoken

        encode = tiktoken.Encoding("runs", pat_str=pattern, mergeable_ranks=shipped.value, special_tokens={}).encode_ordinary
        for batch in batches:
            out = []
            for value in batch.column("text"):
                text = value.as_py() or ""
                known = known_spans(text)
                more = list(random_spans(text, encode, known))
                kinds = [k for _, _, k in known]
                out.append((*(kinds.count(k) for k in KINDS[:3]), listed(known), listed(known + more)))
            n_assign, n_access, n_hex, base, spans = zip(*out) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_assign, n_access, n_hex)), pa.array(base, pa.string()), pa.array(spans, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"],
            )

    return run


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, spans) of every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return plain.mapInArrow(_scan(shipped, pattern), "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string")


def base_digest() -> F.Column:
    return F.sha2(F.col("base"), 256)


def redact(text: str, spans: str, mask: str = "[secret]") -> str:
    """A text with its spans replaced; overlapping spans give one mask."""
    out, at = [], 0
    for span in filter(None, spans.split(",")):
        _, lo, hi = span.split(":")
        lo, hi = int(lo), int(hi)
        if lo >= at:
            out += [text[at:lo], mask]
        at = max(at, hi)
    return "".join([*out, text[at:]])
