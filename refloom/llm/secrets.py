"""Secrets in texts: fixed patterns, and strings that a primed compressor can't shorten.

Novelty: in a context that speaks of credentials, every long unbroken string is compressed twice with
zstandard, once as what follows the text around it and once left out. The dictionary is a list of code
identifiers and the text on both sides. The bytes that the string adds, for each of its characters,
are its novelty: words, repeats and identifiers of the surroundings cost next to nothing, random keys
nearly all their entropy. Huffman tables need some length to pay: a shorter string is asked for a fixed
novelty, a longer one for that share of its alphabet's entropy. A string without a digit isn't a key if most
of its letter pairs are those of words. Key lines that follow a key, and all of a PEM body, are keys too.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from itertools import pairwise

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from refloom.session import ship

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
#: A text with none of these, lower-cased, has no match of the pattern above.
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# runs of 24 and more are the maximal runs of [0-9a-f]+ that are long enough
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

#: Words that make a context sensitive, looked for in the characters before a candidate.
SENSITIVE = re.compile(
    r"passw|secret|token|api.?key|private.?key|access.?key|credential|bearer|authorization|signing.?key|client.?id",
    re.IGNORECASE | re.ASCII,
)
#: A text with none of these, lower-cased, has no sensitive context.
_SENSITIVE_WORDS = ("passw", "secret", "token", "key", "credential", "bearer", "authorization", "client")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_SPACE = re.compile(r"\s")
#: A line of nothing but a candidate, after the end of another.
_NEXT_LINE = re.compile(r"[^\S\n]*\n[^\S\n]*[A-Za-z0-9+/_=-]{16,}(?!\S)")
_PEM, _PEM_END = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY[A-Z0-9 ]*-----"), "-----END"
LEAST_LENGTH, BEFORE, AROUND = 16, 48, 256
#: Compressed bytes that a character of a secret adds at least; from LONG characters, with an alphabet of 64.
LEAST_NOVELTY, LONG = 0.6, 64
_ALPHABETS = (
    (10, re.compile(r"[0-9]+")),
    (16, re.compile(r"[0-9a-f]+|[0-9A-F]+")),
    (36, re.compile(r"[0-9a-z]+|[0-9A-Z]+")),
    (64, re.compile(r".+", re.DOTALL)),
)
#: Each letter with those that often follow it in English, German, French and Spanish words.
_PAIRS = frozenset(
    x[0] + y
    for x in (
        "abcdgiklmnprstuvy baeiloru caehiklortu daeiorsu eabcdeilmnrstuvxy faefioru gaehilnoru haeioutr iabcdeglmnorstuvz "
        "jaeou kaeilnost ladeilostuy mabeimopu nacdeginostu obcdfgilmnoprstuvw paehiloprstu qu radegiklmnorstuy saceihkopstu "
        "taehiorstuyz uabceglmnrst vaeio waehino xaceipt yaeos zaeitu"
    ).split()
    for y in x[1:]
)
#: Share of such pairs from which a string is made of words; about 0.36 of random pairs are among them.
MOST_WORDY = 0.7
#: Longest piece of a candidate that is measured at once; a longer one is measured by such pieces.
PIECE = 4096
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key private_key public_key client_id client_secret "
    "authorization bearer credential username user_name config settings environment production development "
    "function return import export default const static void string integer boolean true false null none "
    "example placeholder changeme xxxxxxxxxxxx your_api_key_here abcdefghijklmnopqrstuvwxyz "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890 0000000000000000 http:// https:// www. .com .org "
    "getElementById addEventListener toString hashCode initialize connection database request response"
).encode()


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Matches of the three patterns as (start, end, kind), each kind leftmost and without overlaps;
    ends are exclusive, both in code points. Matches that are too short are consumed, then dropped."""
    low = text.lower()
    out = []
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=_order)


def _order(span: tuple[int, int, str]) -> tuple:
    return span[0], KINDS.index(span[2]), span[1]


def novelty(candidate: str, before: str, after: str) -> float:
    """Compressed bytes that the candidate adds to its surroundings, for each of its characters."""
    known = zstandard.ZstdCompressionDict(
        IDENTIFIERS + b"\n" + after.encode() + b"\n" + before.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT
    )
    press = zstandard.ZstdCompressor(level=9, dict_data=known, write_content_size=False, write_dict_id=False)
    bare = len(press.compress(b""))
    parts = (candidate[i : i + PIECE].encode() for i in range(0, len(candidate), PIECE))
    return sum(len(press.compress(p)) - bare for p in parts) / len(candidate)


def spans(text: str, least_novelty: float = LEAST_NOVELTY) -> list[tuple[int, int, str]]:
    """The base matches, PEM bodies, and the novel strings in sensitive contexts; of the last two what the
    base matches leave."""
    found = base_spans(text)
    for a, b in _pem_bodies(text):
        found += [(x, y, "novel") for x, y in _free(a, b, _disjoint(found)) if not text[x:y].isspace()]
    taken = _disjoint(found)
    at = 0
    for a, b in _contexts(text):
        at = max(at, a)
        while m := _CANDIDATE.search(text, at, b):
            at = m.end()
            keys = [(x, y) for x, y in _free(*m.span(), taken) if y - x >= LEAST_LENGTH and _is_key(text, x, y, least_novelty)]
            found += [(x, y, "novel") for x, y in keys]
            if (keys or _covered(m.span(), taken)) and (line := _NEXT_LINE.match(text, at)):
                b = max(b, line.end())
    return sorted(found, key=_order)


def _disjoint(found: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b, _ in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _free(a: int, b: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What the disjoint, sorted stretches leave of a to b."""
    out = []
    for x, y in taken[max(0, bisect_right(taken, (a, a)) - 1) :]:
        if x >= b:
            break
        if a < x:
            out.append((a, x))
        a = max(a, y)
    return [*out, (a, b)] if a < b else out


def _covered(span: tuple[int, int], taken: list[tuple[int, int]]) -> bool:
    return not _free(*span, taken)


def _is_key(text: str, a: int, b: int, least_novelty: float) -> bool:
    found = text[a:b]
    return not _wordy(found) and novelty(found, text[max(0, a - AROUND) : a], text[b : b + AROUND]) >= _least(found, least_novelty)


def _least(candidate: str, least_novelty: float) -> float:
    if len(candidate) < LONG:
        return least_novelty
    size = next(n for n, own in _ALPHABETS if own.fullmatch(candidate))
    return least_novelty * math.log2(size) / 6


def _wordy(candidate: str) -> bool:
    if any(c.isdigit() for c in candidate):
        return False
    low = candidate.lower()
    pairs = [x + y for x, y in pairwise(low) if x.isalpha() and y.isalpha()]
    return sum(p in _PAIRS for p in pairs) >= MOST_WORDY * len(pairs) if pairs else False


def _pem_bodies(text: str) -> list[tuple[int, int]]:
    """What stands between the lines that begin and end private keys."""
    out, end = [], -1
    for m in _PEM.finditer(text):
        if end < m.end() and (end := text.find(_PEM_END, m.end())) < 0:
            break
        if text.find("-----BEGIN", m.end(), end) < 0 and (body := text[m.end() : end].strip()):
            a = text.index(body, m.end())
            out.append((a, a + len(body)))
    return out


def _contexts(text: str) -> list[tuple[int, int]]:
    """Stretches in which a candidate may begin, after a sensitive word; no two overlap. They end with a
    word, so no candidate is cut."""
    out: list[tuple[int, int]] = []
    low = text.lower()
    if not any(w in low for w in _SENSITIVE_WORDS):
        return out
    for m in SENSITIVE.finditer(text):
        a, b = m.end(), min(m.end() + BEFORE, len(text))
        if out and b <= out[-1][1]:
            continue
        b = end.start() if (end := _SPACE.search(text, b)) else len(text)
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _told(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


def found_secrets(docs: DataFrame, id: str = "doc_id", text: str = "text", least_novelty: float = LEAST_NOVELTY) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) of every row; spans are kind:start:end.

    Null texts count as empty. Rows are independent: repeated ones give repeated results, nulls in
    other columns and further columns are ignored, an empty table gives an empty result.
    """
    schema = T.StructType(
        [docs.schema[id]]
        + [T.StructField(c, T.LongType(), False) for c in ("n_assign", "n_access", "n_hex")]
        + [T.StructField(c, T.StringType(), False) for c in ("base_sha256", "spans")]
    )
    names = schema.names

    def run(batches):
        for b in batches:
            rows = []
            for x in b.column(text):
                every = spans(x.as_py() or "", least_novelty)
                base = [s for s in every if s[2] != "novel"]
                kinds = [s[2] for s in base]
                rows.append(
                    (
                        *(kinds.count(k) for k in KINDS[:3]),
                        hashlib.sha256(_told(base).encode()).hexdigest(),
                        _told(every),
                    )
                )
            own = list(zip(*rows, strict=True)) if rows else [()] * 5
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(id), *map(pa.array, own, types)], names)

    ship(docs.sparkSession)
    return docs.select(id, text).mapInArrow(run, schema)


def redacted(docs: DataFrame, text: str = "text", mask: str = "[secret]", least_novelty: float = LEAST_NOVELTY) -> DataFrame:
    """docs with every secret of its texts replaced by mask; of a key and its value, both go.
    Null texts stay null."""

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index(text)
            yield b.set_column(at, b.schema.field(at), pa.array([_mask(x.as_py()) for x in b.column(text)], b.schema.field(at).type))

    def _mask(x):
        if not x:
            return x
        out, end = [], 0
        for a, b, _ in spans(x, least_novelty):
            if a >= end:
                out += [x[end:a], mask]
            end = max(end, b)
        return "".join([*out, x[end:]])

    ship(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
