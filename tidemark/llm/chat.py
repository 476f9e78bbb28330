"""Chat formatting at token level.

Each turn is assembled from token ids: a reserved id opens it, its escaped text
is encoded by itself, and a reserved id closes it.  Reserved ids never come out of
encoding a text, so content cannot forge a turn; in the readable form the control
strings inside contents are escaped, which is undone in reading.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: how the public vocabulary splits a text before merging
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class ChatTemplate:
    """Control strings: one opens the turn of each known role, any other role is spelled out.

    The reserved id of control string ``k`` is the vocabulary size plus ``k``.
    """

    roles: tuple[str, ...] = ("system", "user", "assistant", "tool")
    opening: str = "### {}: "
    other: str = "### Role "
    role_end: str = " ###: "
    closing: str = "</turn>\n"
    learn: tuple[str, ...] = ("assistant",)

    @cached_property
    def controls(self) -> list[str]:
        return [*(self.opening.format(r.capitalize()) for r in self.roles), self.other, self.role_end, self.closing]

    def guarded(self) -> list[str]:
        """What must not occur unescaped in a content: the controls without outer white space."""
        return sorted({c.strip() for c in self.controls}, key=lambda c: (-len(c), c))

    def escape(self, text: str) -> str:
        """A backslash before every backslash and every control string."""
        return self._special.sub(lambda m: "\\" + m.group(), text)

    def unescape(self, text: str) -> str:
        return self._escaped.sub(lambda m: m.group(1), text) if "\\" in text else text

    @cached_property
    def _special(self) -> re.Pattern:
        return re.compile("|".join([r"\\", *map(re.escape, self.guarded())]))

    @cached_property
    def _escaped(self) -> re.Pattern:
        return re.compile(r"\\(" + self._special.pattern + ")")


#: The encoding that this process has built, by the hash of its ranks; it outlives the tasks of a reused worker.
_BUILT: dict[str, object] = {}


@dataclass
class Vocabulary:
    """Byte-pair ranks as lines of base64 and number; they travel with the tasks, so executors need no file."""

    lines: bytes

    @classmethod
    def load(cls, path: str = RANKS_PATH) -> Vocabulary:
        with open(path, "rb") as file:
            return cls(file.read())

    @cached_property
    def mark(self) -> str:
        return hashlib.sha256(self.lines).hexdigest()

    @property
    def encoding(self):
        mark = self.mark
        if mark not in _BUILT:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in self.lines.splitlines() if line.strip())}
            _BUILT.clear()
            _BUILT[mark] = tiktoken.Encoding("chat", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        return _BUILT[mark]

    @cached_property
    def size(self) -> int:
        return self.encoding.max_token_value + 1


def assemble(roles: list[str], texts: list[str], vocabulary: Vocabulary, template: ChatTemplate) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Token ids and loss mask of each turn.

    All segments are encoded separately and in one call; where a segment begins,
    and which positions the mask covers, follows from prefix sums of their lengths.
    """
    first = vocabulary.size
    known = {r: first + k for k, r in enumerate(template.roles)}
    other, role_end, closing = (first + len(template.roles) + k for k in range(3))
    encoded = iter(vocabulary.encoding.encode_ordinary_batch([template.escape(x) for role, text in zip(roles, texts) for x in ([text] if role in known else [role, text])], num_threads=1))
    ids, masks = [], []
    for role in roles:
        if role in known:
            segments = [[known[role]], next(encoded), [closing]]
        else:
            segments = [[other], next(encoded), [role_end], next(encoded), [closing]]
        starts = np.cumsum([0, *map(len, segments)])
        edge = np.zeros(starts[-1] + 1, np.int8)
        if role in template.learn:
            edge[starts[-3]] += 1
            edge[starts[-2]] -= 1
        ids.append(np.concatenate([np.array(s, np.int32) for s in segments]))
        masks.append(np.cumsum(edge[:-1], dtype=np.int8))
    return ids, masks


def read_turn(ids: list[int], mask: list[int], vocabulary: Vocabulary, template: ChatTemplate, encoding=None) -> tuple[str, str, str, str]:
    """``(role, text, masked text, readable form)`` of a formatted turn."""
    encoding = encoding or vocabulary.encoding
    first, controls, decode = vocabulary.size, template.controls, encoding.decode_bytes
    plain: list[tuple[int, list[int]]] = []
    for k in ids:
        if k >= first:
            plain.append((k - first, []))
        else:
            plain[-1][1].append(k)
    texts = [decode(t).decode("utf-8", "replace") for _, t in plain]
    readable = "".join(controls[c] + t for (c, _), t in zip(plain, texts))
    if plain[0][0] < len(template.roles):
        role, text = template.roles[plain[0][0]], texts[0]
    else:
        role, text = template.unescape(texts[0]), texts[1]
    learned = decode([k for k, m in zip(ids, mask) if m and k < first]).decode("utf-8", "replace")
    return role, template.unescape(text), template.unescape(learned), readable


def format_turns(turns: DataFrame, vocabulary: Vocabulary, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """``(conv_id, turn, ids, mask)`` of every row of ``turns (conv_id, turn, role, text)``.

    Null roles and texts count as empty.  Turns are formatted one by one, so a
    conversation of any length takes no more memory than its longest turn;
    the ids of a conversation are those of its rows in the order of ``turn``.
    Repeated rows give repeated turns; other columns are ignored.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = turns.select("conv_id", "turn", text("role"), text("text"))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, masks = assemble(part.column("role").to_pylist(), part.column("text").to_pylist(), vocabulary, template)
                ends = pa.array(np.cumsum([0, *map(len, ids)], dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("conv_id"), part.column("turn"),
                        pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids))), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(masks))),
                    ],
                    ["conv_id", "turn", "ids", "mask"],
                )

    return rows.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, ids array<int>, mask array<tinyint>")


def read_turns(formatted: DataFrame, vocabulary: Vocabulary, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """``(conv_id, turn, role, text, learned, formatted)`` read back from formatted turns."""
    rows = formatted.select("conv_id", "turn", "ids", "mask")
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = vocabulary.encoding
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                read = [read_turn(i, m, vocabulary, template, encoding) for i, m in zip(part.column("ids").to_pylist(), part.column("mask").to_pylist())]
                columns = [pa.array(c, pa.string()) for c in zip(*read)]
                yield pa.RecordBatch.from_arrays([part.column("conv_id"), part.column("turn"), *columns], ["conv_id", "turn", "role", "text", "learned", "formatted"])

    return rows.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string, learned string, formatted string")


class _Digest:
    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, role: str, text: str, learned: str, formatted: str) -> None:
        self.turns.update(f"{role}\n{text}\n".encode())
        self.loss.update(learned.encode())
        self.n, self.loss_chars, self.chars = self.n + 1, self.loss_chars + len(learned), self.chars + len(formatted)

    def row(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def digest_conversations(read: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)`` per conversation.

    Turns follow in the order of ``turn`` (nulls first), equal ones by role and text.
    A SHA-256 over a conversation has to see it in order: the rows of each are sorted
    by Spark and streamed through three running numbers and two hash states.
    """
    kind = read.schema["conv_id"].dataType.simpleString()
    rows = read.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "learned", "formatted")]
            for conv, *parts in zip(*columns):
                if state is None or conv != key:
                    if state is not None:
                        done.append((key, *state.row()))
                    key, state = conv, _Digest()
                state.add(*parts)
            if done:
                yield _rows(done, batch.schema.field("conv_id").type)
            last = batch.schema.field("conv_id").type
        if state is not None:
            yield _rows([(key, *state.row())], last)

    return rows.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def _rows(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
