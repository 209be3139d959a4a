"""Operator 11: conversations as training texts with token ids and an offset-aligned loss mask.

A turn is rendered as TURN role TEXT text END and a new line. A control string inside
a role or text gets a backslash behind its "<", one more than it has (escaped()), so
an unescaped one marks a turn and nothing else, and unescaped() gives the text back.
Control strings hold "<" at their begin only, so none can straddle a text's edge.

format_conversations() renders a conversation, encodes it once with offsets and finds
the tokens of each learnt span by binary search in the sorted offsets. Control strings
are tokens of their own, behind the vocabulary's ids, so no token straddles the edge of
a text; the vocabulary's own special strings are plain text. Conversations are dealt
out by id and read in order of their turns, a row at a time. What a task holds is
bounded: a conversation of over SEGMENT code points is cut between turns into
segments, rows of rising segment number, which no token could cross either. The rows
of one conversation go through one task, as their order is that of its text.

Nulls and odd rows: a null role or text counts as empty; rows without a conv_id are
one conversation without id; a null turn comes first; equal turns are ordered by role,
then text; repeated rows are turns of their own; an empty text has no tokens; an empty
table has no conversations; other columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TURN, TEXT, END = "<turn>", "<text>", "</turn>"
#: Code points of rendered text from which a conversation goes on in a new segment.
SEGMENT = 1 << 22
#: Code points of rendered text and conversations that are encoded and returned together.
PACK, PACK_ROWS = 1 << 20, 1000
_PLAIN = re.compile(r"<(\\*)(?=/?turn>|text>)")
_ESCAPED = re.compile(r"<\\(\\*)(?=/?turn>|text>)")
_MARKED = re.compile(f"{TURN}(.*?){TEXT}(.*?){END}\n", re.S)
_SCHEMA = (
    "conv_id long, segment int, n_turns long, text string, ids array<int>, begins array<int>, ends array<int>, "
    "loss array<boolean>"
)
_loaded: dict[str, object] = {}


def escaped(text: str) -> str:
    """The text with one more backslash behind the "<" of each control string."""
    return _PLAIN.sub(r"<\\\1", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"<\1", text)


def turns_of(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a rendered text."""
    return [(unescaped(role), unescaped(said)) for role, said in _MARKED.findall(text)]


def tokenizer(vocabulary: str):
    """The vocabulary with the control strings as tokens, loaded once in each Python worker."""
    if vocabulary not in _loaded:
        from tokenizers import AddedToken, Tokenizer

        loaded = Tokenizer.from_file(vocabulary)
        loaded.encode_special_tokens = True
        loaded.add_tokens([AddedToken(mark, special=False, normalized=False) for mark in (TURN, TEXT, END)])
        _loaded[vocabulary] = loaded
    return _loaded[vocabulary]


class Rendered:
    """A conversation's text as it grows by turns, and the spans to be learnt."""

    def __init__(self, conv_id: int | None, segment: int):
        self.conv_id, self.segment, self.n_turns, self.size = conv_id, segment, 0, 0
        self.parts: list[str] = []
        self.spans: list[tuple[int, int]] = []

    def add(self, role: str, said: str, learnt: bool) -> None:
        head, said = f"{TURN}{escaped(role)}{TEXT}", escaped(said)
        begin = self.size + len(head)
        if learnt:
            self.spans.append((begin, begin + len(said)))
        self.parts += [head, said, END, "\n"]
        self.size = begin + len(said) + len(END) + 1
        self.n_turns += 1


def under(spans: list[tuple[int, int]], begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which tokens lie in one of the spans; spans and offsets are sorted, spans don't overlap."""
    begin, end = np.array(spans, np.int64).reshape(-1, 2).T
    first, last = np.searchsorted(ends, begin, "right"), np.searchsorted(begins, end, "left")
    change = np.zeros(len(begins) + 1, np.int64)
    some = first < last
    np.add.at(change, first[some], 1)
    np.subtract.at(change, last[some], 1)
    return np.cumsum(change[:-1]) > 0


def rendered(batches: Iterable[pa.RecordBatch], learnt: frozenset[str], segment: int) -> Iterator[Rendered]:
    """Conversations of rows (conv_id, role, text) that come in order."""
    now: Rendered | None = None
    for batch in batches:
        for conv_id, role, said in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            if now is None or now.conv_id != conv_id:
                if now:
                    yield now
                now = Rendered(conv_id, 0)
            elif now.size >= segment:
                yield now
                now = Rendered(conv_id, now.segment + 1)
            now.add(role, said, role in learnt)
    if now:
        yield now


def _packs(found: Iterable[Rendered]) -> Iterator[list[Rendered]]:
    pack, size = [], 0
    for one in found:
        pack.append(one)
        size += one.size
        if size >= PACK or len(pack) >= PACK_ROWS:
            yield pack
            pack, size = [], 0
    if pack:
        yield pack


def _encoded(vocabulary: str, learnt: frozenset[str], segment: int):
    def run(batches):
        encode = tokenizer(vocabulary).encode
        for pack in _packs(rendered(batches, learnt, segment)):
            texts, columns, edges = ["".join(one.parts) for one in pack], [[], [], [], []], [0]
            for one, text in zip(pack, texts, strict=True):
                found = encode(text, add_special_tokens=False)
                offsets = np.array(found.offsets, np.int32).reshape(-1, 2)
                mask = under(one.spans, offsets[:, 0], offsets[:, 1])
                for column, values in zip(columns, (np.array(found.ids, np.int32), *offsets.T, mask), strict=True):
                    column.append(values)
                edges.append(edges[-1] + len(mask))
            lists = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate(c))) for c in columns]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([one.conv_id for one in pack], pa.int64()), pa.array([one.segment for one in pack], pa.int32()),
                    pa.array([one.n_turns for one in pack], pa.int64()), pa.array(texts, pa.string()), *lists,
                ],
                ["conv_id", "segment", "n_turns", "text", "ids", "begins", "ends", "loss"],
            )

    return run


def format_conversations(
    turns: DataFrame, vocabulary: str, learnt: frozenset[str] = frozenset({"assistant"}), segment: int = SEGMENT
) -> DataFrame:
    """conv_id, segment, n_turns, text, ids, begins, ends (code points of each token in text), loss (a flag a token).

    turns: conv_id, turn, role, text. learnt: the roles whose texts are under the loss mask.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(_encoded(vocabulary, learnt, segment), _SCHEMA)


def learnt_text(text: str, begins: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> list[str]:
    """The texts under the mask, unescaped: one for each run of its tokens."""
    change = np.flatnonzero(np.diff(loss.astype(np.int8), prepend=0, append=0))
    return [unescaped(text[a:b]) for a, b in zip(begins[change[0::2]].tolist(), ends[change[1::2] - 1].tolist(), strict=True)]


class _Digests:
    """Digests of one conversation over its segments."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.loss = conv_id, hashlib.sha256(), hashlib.sha256()
        self.sums = np.zeros(3, np.int64)

    def add(self, text: str, begins: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> None:
        said, turns = learnt_text(text, begins, ends, loss), turns_of(text)
        for one in said:
            self.loss.update(one.encode())
        for role, one in turns:
            self.turns.update(f"{role}\n{one}\n".encode())
        self.sums += [len(turns), sum(map(len, said)), len(text)]


_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest_rows(found: list[_Digests]) -> pa.RecordBatch:
    n_turns, loss_chars, formatted = np.array([x.sums for x in found], np.int64).reshape(-1, 3).T
    return pa.RecordBatch.from_pydict({
        "conv_id": pa.array([x.conv_id for x in found], pa.int64()), "n_turns": n_turns,
        "turns_sha256": [x.turns.hexdigest() for x in found], "loss_chars": loss_chars,
        "loss_sha256": [x.loss.hexdigest() for x in found], "formatted_chars": formatted,
    })


def _read_back(batches):
    """Digests of each conversation; the rows are format_conversations()'s own, segment after segment."""
    now: list[_Digests] = []
    for batch in batches:
        lists = [(np.asarray(batch.column(c).offsets), batch.column(c).values.to_numpy(zero_copy_only=False)) for c in (3, 4, 5)]
        for row, (conv_id, segment, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
            if segment == 0:
                if len(now) >= PACK_ROWS:
                    yield _digest_rows(now)
                    now = []
                now.append(_Digests(conv_id))
            now[-1].add(text, *(values[edges[row] : edges[row + 1]] for edges, values in lists))
    if now:
        yield _digest_rows(now)


#: A conversation that says control strings of this and of another template.
_PROBE = "\\### Assistant: </turn> ok"


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests, read back from the formatted text, mask and offsets, of all conversations and of one more, -7."""
    import public_tokenizers

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_PROBE).alias("text"),
    )
    formatted = format_conversations(turns.unionByName(probe), public_tokenizers.path("byte_bpe_50k.json"))
    return formatted.select("conv_id", "segment", "text", "begins", "ends", "loss").mapInArrow(_read_back, _DIGESTS)


OP11_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, regexp_replace(role, '<(\\*)(/?turn>|text>)', '<\\\1\2', 'g') AS safe_role,
    regexp_replace(text, '<(\\*)(/?turn>|text>)', '<\\\1\2', 'g') AS safe_text FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(safe_role) + length(safe_text) + 20)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""
