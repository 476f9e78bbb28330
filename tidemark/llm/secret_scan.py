"""Secrets by patterns and by dictionary-primed compression novelty.

The patterns find assignments, access keys and long hex runs.  Beyond them,
every long unbroken string near a sensitive word is compressed with zstandard
under a dictionary of common identifiers and the text around it: what a reader
could have guessed from either costs nearly nothing, a secret costs all its bytes.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from tidemark.llm import bytetext

#: Kinds in the order in which spans at one place are listed.
KINDS = ("assign", "access", "hex", "novel")

# fixed values
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_SEPARATORS = re.compile(rb"[+/_=-]+")
_SENSITIVE = re.compile(rb"key|secret|token|passw|pwd|auth|credential|bearer|private|signature", re.IGNORECASE)
_IDENTIFIERS = (
    b"access account address algorithm apiKey application argument array async attribute author authorization await base64 "
    b"boolean buffer bytes cache callback certificate charset class client clientId clientSecret collection column command "
    b"config configuration connection console const constructor content context controller cookie count create credential "
    b"database default default_value delete description directory document element encoding endpoint environment error event "
    b"exception export expires extends false field filename final float format function getElementById handler hash header "
    b"header_name host http https identifier implements import index input insert instance integer interface items iterator "
    b"javascript json key keyword lambda language length library list local localhost location logger login manager message "
    b"metadata method middleware model module namespace null number object operator option output package parameter parent "
    b"parse passphrase path pattern payload permission placeholder plugin pointer port position prefix primary_key private "
    b"privateKey process profile promise property protected protocol provider proxy public publicKey query queue random "
    b"readonly record redirect reference refreshToken register release remote request require resource response result return "
    b"router schema scope script secret_key select server service session sessionId settings signature source static status "
    b"stream string struct subscribe suffix system table target template test thread timeout timestamp token_type transaction "
    b"true type undefined update upload url user user_id user_name username utf-8 validate value variable vector version "
    b"virtual void webhook width window wrapper www.example.com xml yaml your_api_key_here changeme xxxxxxxxxxxxxxxxxxxxxxxx "
    b"00000000000000000000000000000000 0123456789abcdef abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ"
)


@dataclass(frozen=True)
class SecretRule:
    """When a string is long, near enough to a sensitive word, and novel.

    ``novelty`` is the least share of its bytes that a string must cost beyond the
    frame; of an alphabet so small that random strings cost less, ``randomness`` is the
    share of the alphabet's entropy instead.  ``context`` is the bytes of text to either
    side that prime the dictionary, ``solid`` the run without separators from which a
    string is no row of words.
    """

    least: int = 16
    near: int = 48
    context: int = 512
    novelty: float = 0.75
    randomness: float = 0.95
    solid: int = 64


def _table(ranges: str, extra: str = "") -> np.ndarray:
    out = np.zeros(256, bool)
    for first, last in zip(ranges[::2], ranges[1::2]):
        out[ord(first) : ord(last) + 1] = True
    for c in extra:
        out[ord(c)] = True
    return out


_HEX = _table("09af")
_TOKEN = _table("09azAZ", "+/_-=")


def _long_runs(table: np.ndarray, data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    starts, ends = bytetext.runs(table[data], offsets)
    long = ends - starts >= least
    return starts[long], ends[long]


def assignments(text: bytes, lower: bytes) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches with six or more characters assigned."""
    places: list[int] = []
    for word in _WORDS:
        at = lower.find(word)
        while at >= 0:
            places.append(at)
            at = lower.find(word, at + 1)
    found, free = [], 0
    for at in sorted(places):
        if at >= free and (m := _ASSIGN.match(text, at)):
            free = m.end()
            if m.end(2) - m.start(2) >= 6:
                found.append(m.span())
    return found


def marginal_bytes(string: bytes, context: bytes) -> int:
    """Bytes that ``string`` costs when ``context`` and the common identifiers are known."""
    primed = zstandard.ZstdCompressionDict(_IDENTIFIERS + context, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packer = zstandard.ZstdCompressor(level=19, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
    return len(packer.compress(string)) - len(packer.compress(b""))


def _alphabet_size(plain: bytes) -> int:
    """Symbols of the smallest usual alphabet of letters and digits that ``plain`` fits: hex, base32 or all of its cases."""
    cases = any(65 <= c <= 90 for c in plain) + any(97 <= c <= 122 for c in plain)
    if not plain.strip(b"0123456789abcdefABCDEF"):
        return 10 + 6 * cases
    if cases == 1 and not plain.upper().strip(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"):
        return 32
    return 10 + 26 * cases


def least_share(string: bytes, rule: SecretRule) -> float:
    """The share of its bytes from which a string's cost is that of a random one.

    The cost of a long string falls to the entropy of its alphabet, which is below
    ``novelty`` for most.  Words between separators cost no more than that
    either, so other than hex digits a string needs a solid run to be measured by it.
    """
    runs = _SEPARATORS.split(string)
    size = _alphabet_size(b"".join(runs))
    if size > 22 and max(map(len, runs)) < rule.solid:
        return rule.novelty
    return min(rule.novelty, rule.randomness * math.log2(size) / 8)


def novel_strings(text: bytes, runs: list[tuple[int, int]], taken: list[tuple[int, int]], rule: SecretRule) -> list[tuple[int, int]]:
    """Long strings near a sensitive word that neither context nor identifiers explain."""
    found = []
    for start, end in runs:
        if any(a < end and start < b for a, b in taken):
            continue
        before = text[max(0, start - rule.near) : start]
        string = text[start:end]
        mixed = any(c in b"0123456789" for c in string) and any(65 <= c <= 90 or 97 <= c <= 122 for c in string)
        if not mixed or not _SENSITIVE.search(before):
            continue
        context = text[max(0, start - rule.context) : start] + text[end : end + rule.context]
        if marginal_bytes(string, context) >= least_share(string, rule) * len(string):
            found.append((start, end))
    return found


def _spans(data: np.ndarray, offsets: np.ndarray, rule: SecretRule) -> Iterator[list[tuple[int, int, int]]]:
    """For each text of a slice: (start, kind, end) in code points."""
    whole = data.tobytes()
    hex_runs = _by_text(*_long_runs(_HEX, data, offsets, 24), offsets)
    tokens = _by_text(*_long_runs(_TOKEN, data, offsets, rule.least), offsets)
    edges = offsets.tolist()
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        text = whole[a:b]
        spans = [(s, 0, e) for s, e in assignments(text, text.lower())]
        if b"AKIA" in text:
            spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
        spans += [(s - a, 2, e - a) for s, e in hex_runs.get(k, ())]
        if k in tokens:
            base = [(s, e) for s, _, e in spans]
            spans += [(s, 3, e) for s, e in novel_strings(text, [(s - a, e - a) for s, e in tokens[k]], base, rule)]
        if spans and not text.isascii():
            # code points before a byte: all bytes but continuation bytes
            points = np.concatenate([[0], np.cumsum((data[a:b] & 0xC0) != 0x80)])
            spans = [(int(points[s]), kind, int(points[e])) for s, kind, e in spans]
        yield sorted(spans)


def _by_text(starts: np.ndarray, ends: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    out: dict[int, list[tuple[int, int]]] = {}
    of = np.searchsorted(offsets, starts, "right") - 1
    for k, s, e in zip(of.tolist(), starts.tolist(), ends.tolist()):
        out.setdefault(k, []).append((s, e))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find_secrets(docs: DataFrame, rule: SecretRule = SecretRule()) -> DataFrame:
    """``(doc_id, spans, n_assign, n_access, n_hex, n_novel, base_sha256, span_text)`` of every row.

    ``spans`` lists ``(kind, start, end)`` in code points, end exclusive, by start and
    then kind in the order of ``KINDS``; ``base_sha256`` hashes those of the first three
    kinds joined as text, and ``span_text`` is all of them so joined.  The whole
    text is searched.  Null and empty texts have no spans; repeated rows give
    repeated results; other columns are ignored.
    """
    texts = bytetext.id_and_text(docs)
    kind = texts.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bytetext.slices(batches):
            every = list(_spans(*bytetext.flat(part.column("text")), rule))
            counts = [pa.array([sum(k == n for _, k, _ in s) for s in every], pa.int64()) for n in range(4)]
            base = [hashlib.sha256(joined([x for x in s if x[1] < 3]).encode()).hexdigest() for s in every]
            lists = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in s] for s in every]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(lists, pa.list_(span)), *counts, pa.array(base), pa.array([joined(s) for s in every], pa.string())],
                ["doc_id", "spans", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "span_text"],
            )

    schema = "spans array<struct<kind:string,start:bigint,end:bigint>>, n_assign bigint, n_access bigint, n_hex bigint, n_novel bigint"
    return texts.mapInArrow(run, f"doc_id {kind}, {schema}, base_sha256 string, span_text string")
