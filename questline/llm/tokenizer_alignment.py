"""Alignment of two tokenizers over a corpus: groups of tokens that end together, and counts of linked ids.

Both tokenizers cut the same bytes. Where a token of each ends, a group ends, and its last two tokens are
*linked*. Nearly all groups hold one token of each, with the same bytes: an array made once from the two
vocabularies gives the B id for an A id, so these links are counted in a vector as long as the A
vocabulary. Only links of irregular groups become pairs that are shuffled.

Linked ids are written once for each document, so no text is tokenised twice. Very long texts are encoded in
pieces, cut at a single space between two other characters, where neither tokenizer can join what stands on
both sides.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from questline.llm.common import arrays, bound_batches
from questline.session import cut_lineage

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
FOLDER = "/opt/tokenizers"
# Fixed value: how a byte-level vocabulary of this kind cuts text before merging.
A_WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE = "▁"               # how pieces of B write a space
PIECE_CHARS = 1 << 18     # of a text that is encoded at once, about
HELD_PAIRS = 1 << 20      # different irregular pairs a task adds up before it hands them on

_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_ALIGNED = "n_a long, n_b long, n_groups long, groups_sha256 string, links binary"


def byte_of_symbol() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for.

    Printable Latin-1 stands for itself; the other bytes are numbered from code point 256.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """The two tokenizers, the bytes of their ids, and the identity map from A ids to B ids."""

    def __init__(self, folder: str = FOLDER, a_file: str = A_FILE, b_file: str = B_FILE):
        with open(os.path.join(folder, a_file), encoding="utf-8") as file:
            spec = json.load(file)
        model, added = spec["model"], {x["content"]: x["id"] for x in spec["added_tokens"]}
        symbols, vocabulary = byte_of_symbol(), model["vocab"] | added
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(symbols[c] for c in token)
        merged = [x.replace(" ", "", 1) if isinstance(x, str) else "".join(x) for x in model["merges"]]
        if [vocabulary[x] for x in merged] != list(range(256, 256 + len(merged))):
            raise ValueError("the ids of A must follow the order of its merges")
        ranks = {self.a_bytes[i]: i for token, i in model["vocab"].items() if token not in added}
        # Ids in the order of merges are ranks; special tokens are ordinary text.
        self.a = tiktoken.Encoding(a_file, pat_str=A_WORDS, mergeable_ranks=ranks, special_tokens={})
        self.b = SentencePieceProcessor(model_file=os.path.join(folder, b_file))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode()
                        for i, p in enumerate(pieces)]
        # A piece spelled out is used before a byte of the same value.
        known = {x: i for i, x in enumerate(self.b_bytes) if self.b.is_byte(i)}
        known |= {x: i for i, x in reversed(list(enumerate(self.b_bytes))) if not self.b.is_byte(i)}
        self.same = np.array([known.get(x, -1) for x in self.a_bytes], dtype=np.int64)
        # Pieces are safe if no entry of B goes on past a space that follows something else.
        self.in_pieces = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
        self.kind = np.uint32 if len(self.a_bytes) * len(self.b_bytes) < 1 << 32 else np.uint64

    def possible_pairs(self) -> int:
        """How many different pairs can be linked at all: of two tokens that end together one ends with the other."""
        by_bytes: list[dict[bytes, int]] = []
        for bytes_of in (self.a_bytes, self.b_bytes):
            count: dict[bytes, int] = defaultdict(int)
            for x in bytes_of:
                count[x] += 1
            by_bytes.append(count)
        in_a, in_b = by_bytes
        ends_in_b = sum(n * in_b.get(x[k:], 0) for x, n in in_a.items() for k in range(len(x)))
        return ends_in_b + sum(n * in_a.get(x[k:], 0) for x, n in in_b.items() for k in range(1, len(x)))

    def pieces(self, text: str) -> Iterator[str]:
        at = 0
        while self.in_pieces and len(text) - at > PIECE_CHARS and (cut := _BETWEEN.search(text, at + PIECE_CHARS)):
            yield text[at:cut.start()]
            at = cut.end()
        yield text[at:]

    def encode(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of space+text in A and of the text in B; None where the bytes of either differ from space+text."""
        a_ids, b_ids = [], []
        for piece in self.pieces(text):
            a_ids += self.a.encode_ordinary(" " + piece)
            b_ids += self.b.encode(piece)
        whole = (" " + text).encode()
        same = b"".join(map(self.a_bytes.__getitem__, a_ids)) == whole == b"".join(map(self.b_bytes.__getitem__, b_ids))
        return (a_ids, b_ids) if same else None


class Aligner:
    """Aligns texts; holds what that takes for each id."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        sizes = [len(x) for x in tokenizers.a_bytes], [len(x) for x in tokenizers.b_bytes]
        self.a_size, self.b_size = (np.array(x, dtype=np.int64) for x in sizes)
        self.names = {end: np.array([f"{i}{end}" for i in range(max(map(len, sizes)))], dtype=object) for end in ",|;"}

    def __call__(self, text: str | None) -> tuple[int, int, int, str, bytes]:
        """Number of A ids, of B ids and of groups, the digest of all groups, and one link a group."""
        ids = self.tokenizers.encode(text) if text else None
        if ids is None:
            return 0, 0, 0, "", b""
        a, b = (np.array(x, dtype=np.int64) for x in ids)
        a_ends, b_ends = self.a_size[a].cumsum(), self.b_size[b].cumsum()
        ends = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_last, b_last = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
        links = a[a_last] * len(self.b_size) + b[b_last]
        # Each id with what follows it, the A ids of a group before its B ids.
        a_names, b_names = self.names[","][a], self.names[","][b]
        a_names[a_last], b_names[b_last] = self.names["|"][a[a_last]], self.names[";"][b[b_last]]
        b_before = np.r_[0, b_last[:-1] + 1]
        out = np.empty(len(a) + len(b), dtype=object)
        out[np.arange(len(a)) + b_before[np.searchsorted(a_last, np.arange(len(a)))]] = a_names
        out[np.arange(len(b)) + a_last[np.searchsorted(b_last, np.arange(len(b)))] + 1] = b_names
        digest = hashlib.sha256("".join(out.tolist())[:-1].encode()).hexdigest()
        return len(a), len(b), len(ends), digest, links.astype(self.tokenizers.kind).tobytes()


def aligned_texts(docs: DataFrame, folder: str = FOLDER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and the alignment of its text, one row a document; links are packed ids, one for each group."""

    @F.pandas_udf(_ALIGNED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        align = Aligner(Tokenizers(folder))
        for texts in batches:
            yield pd.DataFrame([align(t) for t in texts], columns=[c.split(" ")[0] for c in _ALIGNED.split(", ")])

    return docs.select(F.col(doc_id).alias("doc_id"), run(F.col(text)).alias("r")).select("doc_id", "r.*")


def pair_counts(aligned: DataFrame, folder: str = FOLDER) -> DataFrame:
    """``a, b, n``: how many links of all documents hold the two ids linked."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = Tokenizers(folder)
        regular = np.zeros(len(t.a_bytes), dtype=np.int64)
        held = [np.empty(0, dtype=t.kind), np.empty(0, dtype=np.int64)]

        def rows(a, b, n) -> pd.DataFrame:
            return pd.DataFrame({"a": a.astype(np.int64), "b": b.astype(np.int64), "n": n})

        for batch in batches:
            links = np.frombuffer(b"".join(batch["links"]), dtype=t.kind)
            a, b = np.divmod(links, t.kind(len(t.b_bytes)))
            one_to_one = t.same[a] == b
            regular += np.bincount(a[one_to_one], minlength=len(regular))
            pairs, n = np.unique(links[~one_to_one], return_counts=True)
            both, at = np.unique(np.concatenate([held[0], pairs]), return_inverse=True)
            held = [both, np.bincount(at, np.concatenate([held[1], n]), len(both)).astype(np.int64)]
            if len(both) > HELD_PAIRS:
                yield rows(*np.divmod(both, t.kind(len(t.b_bytes))), held[1])
                held = [both[:0], held[1][:0]]
        at = np.flatnonzero(regular)
        yield rows(at, t.same[at], regular[at])
        yield rows(*np.divmod(held[0], t.kind(len(t.b_bytes))), held[1])

    return aligned.select("links").mapInPandas(count, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def token_links(docs: DataFrame, folder: str = FOLDER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row of ``docs``.

    A group's link is the pair of its last two ids; its count is the number of links of the corpus that hold
    these ids. n_best counts links whose count is the highest of their B id, count_sum adds up all. Null and
    empty texts, and texts that either tokenizer doesn't give back byte for byte, have no tokens: all zero, and
    an empty groups_sha256. Ids may be null or repeated; other columns are not looked at.

    The counts are broadcast: two tokens that end together end with the same bytes, so the vocabularies
    bound the number of pairs (``Tokenizers.possible_pairs``), whatever the corpus.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    aligned = cut_lineage(aligned_texts(docs, folder, doc_id, text))
    table = arrays(cut_lineage(pair_counts(aligned, folder)))
    t = Tokenizers(folder)
    a, b, n = (table[c].astype(np.int64) for c in ("a", "b", "n"))
    order = np.argsort(a * len(t.b_bytes) + b)
    highest = np.zeros(len(t.b_bytes), dtype=np.int64)
    np.maximum.at(highest, b, n)
    key = (a * len(t.b_bytes) + b)[order].astype(t.kind)
    shared = spark.sparkContext.broadcast((key, n[order], (n == highest[b])[order]))

    @F.pandas_udf("n_best long, count_sum long")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        keys, counts, best = shared.value
        for batch in batches:
            out = []
            for raw in batch:
                at = np.searchsorted(keys, np.frombuffer(raw, dtype=keys.dtype))
                out.append((int(best[at].sum()), int(counts[at].sum())))
            yield pd.DataFrame(out, columns=["n_best", "count_sum"])

    return aligned.select("*", score("links").alias("r")).select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "r.n_best", "r.count_sum", "groups_sha256"
    )
