"""Tokenizer alignment against whole-text encoding by the tokenizers' own libraries."""

import hashlib
from collections import Counter

import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from questline.llm import tokenizer_alignment as ta
from questline.llm.queries import QUERIES

ODD = [
    "a b", "  a", "a  ", "\n\na \n b", "x y   z", "\x1c a \x85 b", "don't  stop 's 'll", "▁ x",
    "<s> </s> <unk> <0x0A> <|endoftext|>", "a" * 3000, "é ñ 日本 語", "🙂 🙂🙂 a🙂b", "\x00 b", "﻿ a", "a​ b ​ c",
    "ﬁ ½ ² x", "1 2  3   4", "a \t b", "\r\n x", " ", "\n", "x y", "　 a 　b", "word " * 20_000, "", None,
]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(f"{ta.FOLDER}/{ta.A_FILE}")
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=f"{ta.FOLDER}/{ta.B_FILE}")


def brute(texts, libraries):
    """The rows by text, with groups found one token after the other."""
    a, b = libraries
    symbols = ta.byte_of_symbol()
    rows, counts = [], Counter()
    for text in texts:
        links, groups, ids = [], [], ([], [])
        if text:
            whole = (" " + text).encode()
            ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            sides = ([bytes(symbols[c] for c in a.id_to_token(i)) for i in ids[0]],
                     [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else
                      b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]])
            if b"".join(sides[0]) != whole or b"".join(sides[1]) != whole:
                ids = ([], [])
        at, ends, held = [0, 0], [0, 0], ([], [])
        while at[0] < len(ids[0]) or at[1] < len(ids[1]):
            side = 0 if ends[0] <= ends[1] and at[0] < len(ids[0]) else 1
            held[side].append(ids[side][at[side]])
            ends[side] += len(sides[side][at[side]])
            at[side] += 1
            if ends[0] == ends[1]:
                links.append((held[0][-1], held[1][-1]))
                groups.append("|".join(",".join(map(str, h)) for h in held))
                held = ([], [])
        counts.update(links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        rows.append((len(ids[0]), len(ids[1]), len(groups), links, digest))
    best = Counter()
    for (_, b_id), n in counts.items():
        best[b_id] = max(best[b_id], n)
    return [(n_a, n_b, n, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest)
            for n_a, n_b, n, links, digest in rows]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_odd_texts(spark, libraries):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").repartition(3)
    got = [tuple(r[c] for c in COLUMNS) for r in ta.token_links(docs).orderBy("doc_id").collect()]
    assert got == brute(ODD, libraries)


def test_query_on_small_tables(spark, sf, libraries):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    got = [(r["doc_id"], *[r[c] for c in COLUMNS]) for r in QUERIES["op12_tokenizer_alignment"](spark, sf).orderBy("doc_id").collect()]
    want = brute([d["text"] for d in docs], libraries)
    assert got == [(d["doc_id"], *w) for d, w in zip(docs, want, strict=True)]


def test_pieces_of_long_texts(monkeypatch):
    align = ta.Aligner(ta.Tokenizers())
    texts = [t for t in ODD if t]
    whole = [align(t) for t in texts]
    monkeypatch.setattr(ta, "PIECE_CHARS", 40)
    assert [align(t) for t in texts] == whole


def test_identity_map_and_bound():
    t = ta.Tokenizers()
    assert all(t.b_bytes[b] == t.a_bytes[a] for a, b in enumerate(t.same) if b >= 0)
    assert t.possible_pairs() < 1 << 20


def test_odd_tables(spark, odd, nothing):
    got = ta.token_links(odd)
    assert got.columns == ["doc_id", *COLUMNS[:6], "groups_sha256"]
    rows = got.collect()
    assert len(rows) == 10 and sum(r["n_a"] == 0 for r in rows) == 4
    assert ta.token_links(nothing).count() == 0
