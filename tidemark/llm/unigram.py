"""SentencePiece-style unigram encoding and decoding with any piece list.

A text is cut wherever no piece can reach over: between two bytes that follow
each other in no piece.  Each part takes the best-scored sequence of pieces, found
by Viterbi over a double-array trie; parts seen before are remembered.  Characters without a piece become byte pieces.  White-space
markers are undone in decoding; a literal marker character is encoded as bytes,
so that decoding gives back every text exactly.
"""

from __future__ import annotations

import hashlib
import math
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bytetext

MARKER = "▁"
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0
#: Parts of up to so many bytes are encoded together and remembered, longer ones one by one.
LONG_PART = 48


class DoubleArrayTrie:
    """Byte trie in two arrays: the child of ``node`` by ``byte`` is ``base[node] + byte + 1`` if its ``check`` is ``node``."""

    def __init__(self, keys: list[bytes]) -> None:
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for number, key in enumerate(keys):
            node = 0
            for byte in key:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                node = children[node][byte]
            ends[node] = number
        base, check, value, used = [0], [-1], [-1], bytearray(b"\1")
        # the first 257 slots are the root's: any byte can have its slot beyond them
        free, roomy, stack = 258, 258, [(0, 0)]

        def grow(n: int) -> None:
            if n > len(used):
                more = n - len(used) + len(used) // 2
                used.extend(bytes(more))
                base.extend([0] * more)
                check.extend([-1] * more)
                value.extend([-1] * more)

        while stack:
            node, slot = stack.pop()
            value[slot] = ends.get(node, -1)
            marks = sorted(children[node])
            if not marks:
                continue
            # single children fill the gaps; larger families are looked for where there is room
            while free < len(used) and used[free]:
                free += 1
            first, tries = (free if len(marks) == 1 else max(free, roomy)) - marks[0] - 1 if slot else 0, 0
            grow(first + 258)
            while any(used[first + m + 1] for m in marks):
                first, tries = first + 1, tries + 1
                grow(first + 258)
            if len(marks) > 1 and tries > 32:
                roomy = first + marks[0] + 1
            base[slot] = first
            for m in marks:
                used[first + m + 1] = 1
                check[first + m + 1] = slot
                stack.append((children[node][m], first + m + 1))
        last = max((k for k, c in enumerate(check) if c >= 0), default=0) + 258
        grow(last)
        self.base, self.check, self.value = (np.array(x[:last], np.int32) for x in (base, check, value))
        # a leaf's base leads to slots that never name it as their parent


@dataclass
class UnigramModel:
    """Pieces by id (spaces for markers), their log scores, byte pieces, and the trie over the rest."""

    pieces: list[bytes]
    scores: list[float]
    byte_ids: list[int]
    trie: DoubleArrayTrie
    piece_ids: list[int]

    @classmethod
    def build(cls, pieces: list[tuple[str, float]], byte_ids: dict[int, int], skipped: set[int] = frozenset()) -> UnigramModel:
        """``byte_ids`` maps every byte to the id of its piece; ids in ``skipped`` are never produced."""
        if sorted(byte_ids) != list(range(256)):
            raise ValueError("byte fallback needs a piece for each of the 256 bytes")
        raw = [p.replace(MARKER, " ").encode() for p, _ in pieces]
        for byte, k in byte_ids.items():
            raw[k] = bytes([byte])
        special = set(byte_ids.values()) | set(skipped)
        normal = [k for k in range(len(raw)) if k not in special and raw[k]]
        for k in skipped:
            raw[k] = b""
        return cls(raw, [s for _, s in pieces], [byte_ids[b] for b in range(256)], DoubleArrayTrie([raw[k] for k in normal]), normal)


def rank_scores(n: int, shift: float = 100.0) -> list[float]:
    """Log probabilities of ``n`` pieces ranked by frequency, by the Zipf-Mandelbrot law."""
    total = math.log(sum(1 / (k + shift) for k in range(n)))
    return [-math.log(k + shift) - total for k in range(n)]


def load_model(path: str = MODEL_PATH) -> UnigramModel:
    """Pieces of a SentencePiece model file.

    Scores of a unigram model are log probabilities and are taken as they are.
    Those of a merge model are negative ranks, so each piece gets the log
    probability that its rank suggests.
    """
    import sentencepiece

    reader = sentencepiece.SentencePieceProcessor(model_file=path)
    n = len(reader)
    names, given = [reader.id_to_piece(k) for k in range(n)], [reader.get_score(k) for k in range(n)]
    byte_ids = {int(names[k][3:5], 16): k for k in range(n) if reader.is_byte(k)}
    skipped = {k for k in range(n) if reader.is_control(k) or reader.is_unknown(k) or reader.is_unused(k)}
    ranked = all(s == int(s) for s in given)
    return UnigramModel.build(list(zip(names, rank_scores(n) if ranked else given)), byte_ids, skipped)


class Memory:
    """Encoded parts, in two generations: when the younger is full it replaces the older."""

    def __init__(self, size: int) -> None:
        self.size, self.young, self.old = size, {}, {}

    def add(self, part: bytes, ids: array) -> None:
        if len(self.young) >= self.size:
            self.young, self.old = {}, self.young
        self.young[part] = ids


#: What this worker process remembers, by model; it outlives the tasks of a reused worker.
_REMEMBERED: dict[bytes, Memory] = {}


class Encoder:
    """Encodes byte texts; remembers the pieces of up to twice ``memory`` short parts."""

    def __init__(self, model: UnigramModel, memory: int = 100_000) -> None:
        self.base, self.check, self.value = (a.tolist() for a in (model.trie.base, model.trie.check, model.trie.value))
        self.scores = [model.scores[k] for k in model.piece_ids]
        self.arrays = (*(a.astype(np.int64) for a in (model.trie.base, model.trie.check, model.trie.value)), np.array(self.scores))
        self.ids = model.piece_ids
        self.byte_ids = model.byte_ids
        self.unknown = min(self.scores, default=0.0) - UNKNOWN_PENALTY
        self.apart = cut_table([model.pieces[k] for k in model.piece_ids])
        mark = hashlib.sha256(model.trie.value.tobytes() + repr((self.ids, self.byte_ids, self.scores)).encode()).digest()
        if mark not in _REMEMBERED:
            _REMEMBERED.clear()
            _REMEMBERED[mark] = Memory(memory)
        self.memory = _REMEMBERED[mark]

    def best(self, part: bytes) -> list[int]:
        """The best-scored pieces of a part; on a tie the piece that begins earlier stays."""
        base, check, value, scores = self.base, self.check, self.value, self.scores
        n = len(part)
        reach = [-math.inf] * (n + 1)
        begin, piece = [0] * (n + 1), [-1] * (n + 1)
        reach[0], at = 0.0, 0
        while at < n:
            lead = part[at]
            after = at + (1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            here, node, to, single = reach[at], 0, at, False
            while to < n:
                slot = base[node] + part[to] + 1
                if check[slot] != node:
                    break
                node, to = slot, to + 1
                k = value[node]
                if k >= 0:
                    single = single or to == after
                    if here + scores[k] > reach[to]:
                        reach[to], begin[to], piece[to] = here + scores[k], at, k
            if not single and here + self.unknown > reach[after]:
                reach[after], begin[after], piece[after] = here + self.unknown, at, -1
            at = after
        out: list[int] = []
        at = n
        while at:
            start = begin[at]
            if piece[at] >= 0:
                out.append(self.ids[piece[at]])
            else:
                out.extend(self.byte_ids[b] for b in reversed(part[start:at]))
            at = start
        out.reverse()
        return out

    def best_of_many(self, parts: list[bytes]) -> dict[bytes, array]:
        """What ``best`` gives for each part, with all parts taken one position further at a time."""
        if not parts:
            return {}
        parts = sorted(parts, key=len, reverse=True)
        sizes = np.array([len(p) for p in parts])
        width = int(sizes[0])
        table = np.zeros((len(parts), width + 1), np.uint8)
        table[np.arange(width + 1)[None] < sizes[:, None]] = np.frombuffer(b"".join(parts), np.uint8)
        reach = np.full((len(parts), width + 1), -np.inf)
        reach[:, 0] = 0
        begin, piece = np.zeros((len(parts), width + 1), np.int64), np.full((len(parts), width + 1), -1)
        base, check, value, scores = self.arrays

        def offer(rows: np.ndarray, to: np.ndarray | int, score: np.ndarray, at: int, k: np.ndarray | int) -> None:
            if not len(rows):
                return
            better = score > reach[rows, to]
            rows, score = rows[better], score[better]
            to, k = (x[better] if isinstance(x, np.ndarray) else x for x in (to, k))
            reach[rows, to], begin[rows, to], piece[rows, to] = score, at, k

        for at in range(width):
            active = int(np.searchsorted(-sizes, -at, "left"))
            every = np.flatnonzero((table[:active, at] & 0xC0) != 0x80)
            lead = table[every, at]
            after = at + 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            here, single = reach[every, at], np.zeros(len(every), bool)
            left, node, to = np.arange(len(every)), np.zeros(len(every), np.int64), at
            while len(left):
                slot = base[node] + table[every[left], to] + 1
                ok = (check[slot] == node) & (to < sizes[every[left]])
                left, node, to = left[ok], slot[ok], to + 1
                k = value[node]
                ends = np.flatnonzero(k >= 0)
                found, k = left[ends], k[ends]
                single[found[after[found] == to]] = True
                offer(every[found], to, here[found] + scores[k], at, k)
            rest = np.flatnonzero(~single)
            offer(every[rest], after[rest], here[rest] + self.unknown, at, -1)
        # all best paths at once, from their ends
        place, steps, rows = sizes.copy(), [], np.arange(len(parts))
        while (place > 0).any():
            steps.append((place, piece[rows, place]))
            place = np.where(place > 0, begin[rows, place], 0)
        taken = np.stack([np.where(at > 0, k, -2) for at, k in reversed(steps)], axis=1)
        ids = np.array([*self.ids, -2, -1])[taken]
        known = dict(zip(parts, (array("i", row[row >= 0].astype(np.int32).tobytes()) for row in ids)))
        for r in np.flatnonzero((taken == -1).any(1)).tolist():
            known[parts[r]] = array("i", self.best(parts[r]))
        return known

    def parts(self, text: bytes) -> list[bytes]:
        """``text`` with a marker before it, cut wherever no piece reaches over."""
        if not text:
            return []
        whole = b" " + text
        data = np.frombuffer(whole, np.uint8).astype(np.int32)
        cuts = (np.flatnonzero(self.apart[(data[:-1] << 8) | data[1:]]) + 1).tolist()
        return [whole[a:b] for a, b in zip([0, *cuts], [*cuts, len(whole)])]

    def encode_all(self, texts: list[bytes]) -> list[array]:
        """Ids of each text; an empty text has none.  New short parts of all texts are encoded together."""
        cut, new, memory = [self.parts(t) for t in texts], {}, self.memory
        for parts in cut:
            for part in parts:
                if part not in memory.young and part not in new:
                    new[part] = memory.old.get(part)
        unseen = [p for p, ids in new.items() if ids is None]
        new.update(self.best_of_many([p for p in unseen if len(p) <= LONG_PART]))
        new.update((p, array("i", self.best(p))) for p in unseen if len(p) > LONG_PART)
        young, out = memory.young, []
        for parts in cut:
            ids = array("i")
            for part in parts:
                found = young.get(part)
                ids += new[part] if found is None else found
            out.append(ids)
        for part, ids in new.items():
            if len(part) <= LONG_PART:
                memory.add(part, ids)
        return out

    def encode(self, text: bytes) -> array:
        return self.encode_all([text])[0]


def cut_table(pieces: list[bytes]) -> np.ndarray:
    """For each pair of bytes, first times 256 plus second: whether no piece and no character holds it."""
    table = np.ones(1 << 16, bool)
    for piece in pieces:
        for a, b in zip(piece, piece[1:]):
            table[a << 8 | b] = False
    pairs = np.arange(1 << 16)
    table[(pairs & 0xC0) == 0x80] = False
    return table


class Decoder:
    """Bytes of ids, by copying pieces from one flat array."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the text of ``ids``, without the marker put before it."""
        ids = np.asarray(ids, np.int64)
        sizes = self.sizes[ids]
        shift = np.repeat(self.starts[ids] - (np.cumsum(sizes) - sizes), sizes)
        raw = self.flat[shift + np.arange(len(shift))].tobytes()
        return raw[1:] if raw[:1] == b" " else raw


def encode(docs: DataFrame, model: UnigramModel) -> DataFrame:
    """``(doc_id, ids)`` of every row: the piece ids of the whole text.

    Null and empty texts have no ids.  Repeated rows give repeated results; other
    columns are ignored.  Very long texts are encoded part by part; a part without
    spaces of any length takes time in proportion to it.
    """
    texts = bytetext.id_and_text(docs)
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for part in bytetext.slices(batches):
            lists = [np.frombuffer(ids, np.int32) for ids in encoder.encode_all(bytetext.as_bytes(part.column("text")))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), int_lists(lists)], ["doc_id", "ids"])

    return texts.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def int_lists(lists: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) for x in lists)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *lists])))


def decode(encoded: DataFrame, model: UnigramModel, keep_ids: bool = False) -> DataFrame:
    """``encoded (doc_id, ids)`` as ``(doc_id, n_ids, ids_sha256, decoded)``, and ``ids`` where they are to be kept.

    ``ids_sha256`` hashes the ids as little-endian 32-bit numbers.  Null lists
    count as empty; ids that form no valid UTF-8 give replacement characters.
    """
    bytetext.small_batches(encoded.sparkSession)
    rows = encoded.select("doc_id", "ids")
    kind = rows.schema["doc_id"].dataType.simpleString()
    pieces = model.pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(pieces)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = [np.array([], np.int32) if ids is None else ids for ids in part.column("ids").to_numpy(zero_copy_only=False)]
                yield _decoded(part.column("doc_id"), lists, decoder, part.column("ids") if keep_ids else None)

    return rows.mapInArrow(run, f"doc_id {kind}, {_DECODED}" + ", ids array<int>" * keep_ids)


_DECODED = "n_ids bigint, ids_sha256 string, decoded string"


def _decoded(doc_ids: pa.Array, lists: list[np.ndarray], decoder: Decoder, ids: pa.Array | None) -> pa.RecordBatch:
    columns = [
        doc_ids,
        pa.array([len(x) for x in lists], pa.int64()),
        pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in lists], pa.string()),
        pa.array([decoder.decode(x).decode("utf-8", "replace") for x in lists], pa.string()),
    ]
    names = ["doc_id", "n_ids", "ids_sha256", "decoded"]
    if ids is not None:
        columns, names = [*columns, ids], [*names, "ids"]
    return pa.RecordBatch.from_arrays(columns, names)


def encode_and_decode(docs: DataFrame, model: UnigramModel, keep_ids: bool = False) -> DataFrame:
    """What ``decode`` gives for what ``encode`` gives, in one pass with one worker a task."""
    texts = bytetext.id_and_text(docs)
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(model), Decoder(model.pieces)
        for part in bytetext.slices(batches):
            lists = [np.frombuffer(ids, np.int32) for ids in encoder.encode_all(bytetext.as_bytes(part.column("text")))]
            yield _decoded(part.column("doc_id"), lists, decoder, int_lists(lists) if keep_ids else None)

    return texts.mapInArrow(run, f"doc_id {kind}, {_DECODED}" + ", ids array<int>" * keep_ids)


def round_trip(docs: DataFrame, model: UnigramModel) -> DataFrame:
    """``(doc_id, n_ids, ids_sha256, text_sha256)`` where the last is of the decoded text."""
    return encode_and_decode(docs, model).withColumn("text_sha256", F.sha2("decoded", 256)).drop("decoded")
