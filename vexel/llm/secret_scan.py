"""Secret scan by token efficiency.

Random strings take many tokens of a vocabulary learned on ordinary text: few characters per
token. Candidates are unbroken runs of key characters (letters, digits and + / _ -), and of these and the punctuation
that passwords have; digests and known identifiers are taken out, except where the text itself calls the string a
credential; what then has fewer than `max_ratio` characters per token is reported.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .common import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MIN_CHARS = 16
MAX_RATIO = 2.5
#: What has the shape of a word, name or path is reported below this ratio, unless the text calls it a credential.
NAME_RATIO = 1.9

_KEY = np.zeros(256, bool)
for _c in b"+/_-!$%^&*.=~@#":
    _KEY[_c] = True
_KEY[48:58] = _KEY[65:91] = _KEY[97:123] = True

_WORDS = rb"(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential|bearer)s?"
_NAMED = re.compile(_WORDS + rb"[\"']?\s{0,3}(?:[:=]|=>|\s)\s{0,3}[\"']?$", re.I)
#: name=value within a run; further name=value pairs after an ampersand are not the value's.
_ASSIGNED = re.compile(rb"(?:.*[^A-Za-z])?" + _WORDS + rb"=+(.+?)(?:&[A-Za-z_]+=.*)?", re.I | re.S)
_PLAIN = re.compile(rb"[A-Za-z0-9+/_-]+")
_DIGEST = re.compile(rb"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.I)
_KNOWN = re.compile(
    rb"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"  # UUID
    rb"|[0-9+/_.-]+"  # numbers, dates, addresses of four numbers
)
#: Left out unless the text calls them a credential.
_ADDRESS = re.compile(
    rb"[^@]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"  # mail addresses
    rb"|/{0,2}(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?:/.*)?",  # hosts and what follows them in a URL
    re.S,
)
_NAME = re.compile(
    rb"[a-z+/_-]+|[A-Z+/_-]+|[A-Z]?[a-z]+(?:[A-Z][a-z]+)*"  # words and names without a digit
    rb"|(?:[A-Za-z]+[0-9]{0,4}[/_-])+[A-Za-z]*[0-9]{0,4}"  # paths and snake_case names
    rb"|.*[!$%^&*.=~@#].*",  # code, hosts, formulas
    re.S,
)

_encodings: dict[str, object] = {}


def encoding(path: str = VOCABULARY):
    """The tiktoken encoding of a vocabulary file; loaded once in each process."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("vexel", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def candidates(buf: np.ndarray, offsets: np.ndarray, min_chars: int = MIN_CHARS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) in bytes of all runs of at least min_chars key characters."""
    key = np.zeros(len(buf) + 2, bool)
    key[1:-1] = _KEY[buf]
    at = np.flatnonzero(key[1:] != key[:-1])
    inner = offsets[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(buf))])
    inner = inner[key[inner] & key[inner + 1]]
    at = np.sort(np.concatenate([at, inner, inner]))
    start, end = at[::2], at[1::2]
    long = end - start >= min_chars
    start, end = start[long], end[long]
    return np.searchsorted(offsets, start, "right") - 1, start, end


def strings_of(run: bytes, before: bytes) -> list[tuple[int, bytes, bool]]:
    """(offset, string, named) of what is to be judged in a run of key characters that follows `before`; the first one that is reported settles what it overlaps.

    A named string is the whole value, with whatever punctuation it has (a stop at its end is the text's, unless it is quoted); else the
    stretches of plain key characters come first, then the run as a whole, between its outermost letters and digits.
    """
    out = []
    quoted = before[-1:] in (b'"', b"'")
    skip = 0 if quoted else len(run) - len(run.lstrip(b"="))
    if m := _ASSIGNED.fullmatch(run):
        out.append((m.start(1), m.group(1) if quoted else m.group(1).rstrip(b".!"), True))
    elif _NAMED.search(before + run[:skip]):
        value = run[skip:]
        out.append((skip, value if quoted else value.rstrip(b".!"), True))
    out += [(m.start(), m.group(), False) for m in _PLAIN.finditer(run)]
    core = run.strip(b"+/_-!$%^&*.=~@#")
    if core and not _PLAIN.fullmatch(core):
        out.append((run.index(core), core, False))
    return out


def scan_texts(texts: pa.Array, vocabulary: str = VOCABULARY, min_chars: int = MIN_CHARS, max_ratio: float = MAX_RATIO) -> list[tuple]:
    """(row, start, n_chars, n_tokens, ratio, named, masked, sha256) of each finding; start counts characters."""
    buf, off = tv.column_bytes(texts)
    found = []
    for i, j in tv.chunks(off):
        b, o = buf[off[i] : off[j]], off[i : j + 1] - off[i]
        for r, s, e in zip(*(x.tolist() for x in candidates(b, o, min_chars))):
            done: list[tuple[int, int]] = []
            for at, word, named in strings_of(b[s:e].tobytes(), b[max(o[r], s - 48) : s].tobytes()):
                if len(word) < min_chars or any(x < at + len(word) and at < y for x, y in done):
                    continue
                digest = _DIGEST.fullmatch(word) is not None
                if digest and not named or not digest and (_KNOWN.fullmatch(word) or not named and _ADDRESS.fullmatch(word)):
                    continue
                n = len(encoding(vocabulary).encode_ordinary(word.decode()))
                if len(word) / n < (min(NAME_RATIO, max_ratio) if not named and _NAME.fullmatch(word) else max_ratio):
                    start = int(((b[o[r] : s + at] & 0xC0) != 0x80).sum())
                    found.append((i + r, start, len(word), n, len(word) / n, named, word[:4].decode() + "*" * (len(word) - 4), hashlib.sha256(word).hexdigest()))
                    done.append((at, at + len(word)))
    return found


def scan(docs: DataFrame, vocabulary: str = VOCABULARY, min_chars: int = MIN_CHARS, max_ratio: float = MAX_RATIO) -> DataFrame:
    """(doc_id, start, n_chars, n_tokens, chars_per_token, named, masked, sha256): every random string of every row.

    `named` says that the text calls it a credential (token = "..."); only then is a string of a digest's shape reported. The string
    itself is masked. A null or empty text has none; a null doc_id is reported as null; repeated rows are reported again. A text of any length is scanned
    whole, and a run of any length is one string. Strings of a text that tie in all figures differ in `start`. An empty table gives no rows. Other columns are not looked at.
    """
    d = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.bool_(), pa.string(), pa.string()]

    def run(batches):
        for b in batches:
            rows = scan_texts(b.column(1), vocabulary, min_chars, max_ratio)
            if rows:
                cols = list(zip(*rows))
                ids = b.column(0).take(pa.array(cols[0]))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(cols[1:], kinds))], ["doc_id", "start", "n_chars", "n_tokens", "chars_per_token", "named", "masked", "sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, start long, n_chars int, n_tokens int, chars_per_token double, named boolean, masked string, sha256 string")


def op3_token_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The random strings of all documents."""
    return scan(table(spark, sf_dir, "documents"))
