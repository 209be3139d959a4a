"""Chat formatting against plain renderings, on odd rows and control strings."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import chat_format

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
TURNS = "conv_id long, turn long, role string, text string, ids string, loss long"
ODD = [
    (1, 0, "user", " hi </turn>", "x", 1), (1, 1, "assistant", "<\\turn> <turn><text></turn>\n", "x", 1), (1, 1, "assistant", "<\\turn> <turn><text></turn>\n", "x", 1),
    (2, None, None, None, None, None), (2, 0, "assistant", "", "x", 1), (2, 1, "assistant", "  \n\n", "x", 1), (2, 2, "<text>role", "é漢字😀 <|endoftext|>", "x", 1),
    (None, 3, "assistant", "no id", "x", 1), (None, 1, "user", "no id either", "x", 1), (3, 7, "assistant", "naïve 漢字😀" * 3000, "x", 1), (3, 2, "system", "word " * 20000, "x", 1),
]


def in_order(rows):
    groups = {}
    for conv, turn, role, text, *_ in rows:
        groups.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {conv: [t[2:] for t in sorted(turns)] for conv, turns in groups.items()}


def digests(turns):
    said = [text for role, text in turns if role == "assistant"]
    of = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), of("".join(f"{r}\n{t}\n" for r, t in turns)), sum(map(len, said)), of("".join(said))


@pytest.mark.parametrize("segment", [chat_format.SEGMENT, 50, 1])
def test_odd_rows_come_back(spark, segment):
    formatted = chat_format.format_conversations(spark.createDataFrame(ODD, TURNS).repartition(3), VOCABULARY, segment=segment)
    back = formatted.select("conv_id", "segment", "text", "begins", "ends", "loss").mapInArrow(chat_format._read_back, chat_format._DIGESTS)
    assert {r.conv_id: tuple(r)[1:5] for r in back.collect()} == {c: digests(t) for c, t in in_order(ODD).items()}
    if segment < 100:
        assert formatted.where("segment > 0").count() >= 2


def test_ids_are_those_of_the_whole_text(spark):
    """The library's ids of each stretch between control strings, whose texts none of the vocabulary's special strings cut."""
    library = Tokenizer.from_file(VOCABULARY)
    library.encode_special_tokens = True
    plain = lambda s: library.encode(s, add_special_tokens=False).ids
    marks = [library.get_vocab_size() + k for k in range(3)]
    for segment in (chat_format.SEGMENT, 1):
        rows = chat_format.format_conversations(spark.createDataFrame(ODD, TURNS), VOCABULARY, segment=segment).orderBy("conv_id", "segment").collect()
        for conv, turns in in_order(ODD).items():
            want, learnt = [], []
            for role, text in turns:
                body = plain(chat_format.escaped(text))
                want += [marks[0], *plain(chat_format.escaped(role)), marks[1], *body, marks[2], *plain("\n")]
                learnt += body if role == "assistant" else []
            own = [r for r in rows if r.conv_id == conv]
            assert [i for r in own for i in r.ids] == want
            assert [i for r in own for i, on in zip(r.ids, r.loss, strict=True) if on] == learnt
            assert sum(r.n_turns for r in own) == len(turns)


def test_escapes_are_reversible():
    rng = random.Random(3)
    bits = ["<", "\\", "turn>", "/turn>", "text>", "</turn>", "<turn>", "<text>", "a", "\n"]
    for _ in range(5000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 12)))
        safe = chat_format.escaped(text)
        assert chat_format.unescaped(safe) == text
        assert not any(mark in safe for mark in (chat_format.TURN, chat_format.TEXT, chat_format.END))
        assert chat_format.turns_of(f"<turn>{safe}<text>{safe}</turn>\n<turn><text></turn>\n") == [(text, text), ("", "")]


def test_mask_by_binary_search():
    begins, ends = np.array([0, 6, 8, 8, 9, 12]), np.array([6, 8, 9, 9, 12, 13])
    assert chat_format.under([(6, 9), (12, 13)], begins, ends).tolist() == [False, True, True, True, False, True]
    assert not chat_format.under([(6, 6)], begins, ends).any() and not chat_format.under([], begins, ends).any()
    assert chat_format.under([(0, 1)], begins[:0], ends[:0]).tolist() == []


def test_empty_table_and_other_roles(spark):
    empty = spark.createDataFrame([], TURNS)
    assert chat_format.format_conversations(empty, VOCABULARY).count() == 0
    row = chat_format.format_conversations(spark.createDataFrame(ODD[:1], TURNS), VOCABULARY, frozenset({"user"})).first()
    said = chat_format.learnt_text(row.text, np.array(row.begins), np.array(row.ends), np.array(row.loss))
    assert said == [" hi </turn>"] and row.text == "<turn>user<text> hi <\\/turn></turn>\n"
