"""Chat formatting: schema fingerprints pick the mapping that reads a record's layout.

A record is a JSON object in any of the known layouts. The nested paths of its fields are hashed to
a fingerprint, which selects a declarative mapping to canonical turns of role and text. Turns are
then rendered with control strings around them; control strings inside roles and texts are
escaped in a way that can be undone exactly.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The control strings of common chat templates. The first three mark turns here.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROLS = (
    OPEN, MIDDLE, CLOSE, "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|eot_id|>",
    "<|start_header_id|>", "<|end_header_id|>", "<|begin_of_text|>", "<|end_of_text|>",
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>",
)
ASSISTANT = "assistant"

# What layouts with a list of turns call the roles. A record that is a turn keeps its own.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}


@dataclass(frozen=True)
class Layout:
    """How to read one layout: parts in order, each a role and a text path.

    ``each`` names the list whose entries are turns ('' if the record is itself one); a role that
    starts with '=' is a constant, otherwise a path. ``optional`` text paths may be absent.
    """

    name: str
    parts: tuple[tuple[str, str], ...]
    each: str | None = None
    optional: tuple[str, ...] = field(default=())

    def paths(self) -> set[str]:
        own = {p for role, text in self.parts for p in (role, text) if not p.startswith("=")}
        return {f"{self.each}[].{p}" for p in own} if self.each else own


LAYOUTS = (
    Layout("turn", (("role", "text"),), each=""),
    Layout("turn_content", (("role", "content"),), each=""),
    Layout("messages", (("role", "content"),), each="messages"),
    Layout("messages_text", (("role", "text"),), each="messages"),
    Layout("conversations", (("from", "value"),), each="conversations"),
    Layout("prompt_completion", (("=system", "system"), ("=user", "prompt"), ("=assistant", "completion")), None, ("system",)),
    Layout("prompt_response", (("=system", "system"), ("=user", "prompt"), ("=assistant", "response")), None, ("system",)),
    Layout("instruction", (("=system", "system"), ("=user", "instruction"), ("=user", "input"), ("=assistant", "output")),
           None, ("system", "input")),
    Layout("question_answer", (("=user", "question"), ("=assistant", "answer")), None),
)
KNOWN_PATHS = frozenset(p for layout in LAYOUTS for p in layout.paths())


def paths_of(value: object, prefix: str = "") -> set[str]:
    """Nested field paths of a JSON value; entries of lists share the path with []."""
    if isinstance(value, dict):
        out: set[str] = set()
        for name, inner in value.items():
            out |= paths_of(inner, f"{prefix}.{name}" if prefix else name)
        return out
    if isinstance(value, list):
        return set().union(*(paths_of(inner, f"{prefix}[]") for inner in value)) if value else set()
    return {prefix}


def fingerprint(paths: set[str]) -> str:
    """Hash of the paths that some layout knows; others, such as ids and tags, don't count."""
    return hashlib.sha256("\n".join(sorted(paths & KNOWN_PATHS)).encode()).hexdigest()[:16]


def mappings() -> dict[str, Layout]:
    """Fingerprint to layout, with one entry for every choice of optional fields."""
    out = {}
    for layout in LAYOUTS:
        for n in range(len(layout.optional) + 1):
            for absent in combinations(layout.optional, n):
                out.setdefault(fingerprint(layout.paths() - set(absent)), layout)
    return out


def _string(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns_of(record: object, layout: Layout) -> list[tuple[str, str]]:
    rows = [record] if not layout.each else record[layout.each]
    out: list[tuple[str, str]] = []
    for row in rows:
        for role, path in layout.parts:
            if layout.each is None and path in layout.optional and not row.get(path):
                continue
            name = role[1:] if role.startswith("=") else _string(row.get(role))
            text = _string(row.get(path))
            if layout.each is None and out and out[-1][0] == name:
                out[-1] = (name, f"{out[-1][1]}\n\n{text}")  # an instruction and its input are one turn
            else:
                out.append((ROLES.get(name, name) if layout.each else name, text))
    return out


def canonical_turns(records: DataFrame, record: str, keys: list[str]) -> DataFrame:
    """``keys, fingerprint, layout, position, role, text``: one row a turn.

    A record whose fingerprint no mapping has, or that is no JSON object or null, gives one row
    with null layout, role and text, so nothing is lost in silence. An empty list of turns has no
    known path and is such a record. Null roles and texts become empty.
    """

    @F.pandas_udf("fingerprint string, layout string, turns array<struct<role:string,text:string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = mappings()
        for values in batches:
            out = []
            for value in values:
                try:
                    parsed = json.loads(value) if value is not None else None
                except ValueError:
                    parsed = None
                mark = fingerprint(paths_of(parsed)) if isinstance(parsed, dict) else None
                layout = known.get(mark) if mark else None
                turns = turns_of(parsed, layout) if layout else None
                out.append((mark, layout.name if layout else None,
                            [{"role": r, "text": t} for r, t in turns] if turns is not None else None))
            yield pd.DataFrame(out, columns=["fingerprint", "layout", "turns"])

    read = records.select(*keys, run(F.col(record)).alias("_read"))
    return read.select(
        *keys, "_read.fingerprint", "_read.layout", F.posexplode_outer("_read.turns").alias("position", "_turn")
    ).select(*keys, "fingerprint", "layout", "position", "_turn.role", "_turn.text")


_BREAK = "(" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS) + ")"


def escaped(text: Column) -> Column:
    """Backslashes doubled, and one put after the first character of every control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _BREAK, r"$1\\")


def unescape(text: str) -> str:
    """The inverse: a doubled backslash is one, a single one is dropped."""
    return re.sub(r"\\(\\?)", r"\1", text) if "\\" in text else text


def formatted_turns(turns: DataFrame) -> DataFrame:
    """``turns`` with ``piece``, its rendered form, and loss_start and loss_end within it.

    A conversation's formatted text is its pieces, end to end in order. The loss mask covers
    an assistant's escaped text: [loss_start, loss_end) in code points, equal for other roles.
    """
    role, text = escaped(F.coalesce("role", F.lit(""))), escaped(F.coalesce("text", F.lit("")))
    rows = turns.withColumn("_role", role).withColumn("_text", text)
    start = F.length("_role") + len(OPEN) + len(MIDDLE)
    return rows.withColumns({
        "piece": F.concat(F.lit(OPEN), "_role", F.lit(MIDDLE), "_text", F.lit(CLOSE)),
        "loss_start": start,
        "loss_end": F.when(F.col("role") == ASSISTANT, start + F.length("_text")).otherwise(start),
    }).drop("_role", "_text")


_TURN = re.compile(f"{re.escape(OPEN)}(.*?){re.escape(MIDDLE)}(.*?){re.escape(CLOSE)}", re.DOTALL)


def read_back(piece: str) -> list[tuple[str, str]]:
    """Turns of a formatted text."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(piece)]


def digests(formatted: DataFrame, conv: str, order: list[str]) -> DataFrame:
    """What the formatted conversations say, read back from them: one row a conversation.

    Pieces are sorted within their conversation and streamed, so a conversation of any length
    needs one piece at a time in memory. SHA-256 runs from first to last and can't be split,
    so one conversation is one task's.
    """
    shape = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
             "formatted_chars long")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None

        def row():
            n, turns, loss_chars, loss, chars = state
            return [None if current == (None,) else current[0], n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars]

        for batch in batches:
            done = []
            values = (batch[c] for c in ("conv", "piece", "loss_start", "loss_end"))
            for conv_id, piece, start, end in zip(*values, strict=True):
                key = (None if pd.isna(conv_id) else int(conv_id),)
                if key != current:
                    if state is not None:
                        done.append(row())
                    current, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_back(piece):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                masked = unescape(piece[start:end])
                state[2] += len(masked)
                state[3].update(masked.encode("utf-8", "surrogatepass"))
                state[4] += len(piece)
            if done:
                yield _digest_rows(done)
        if state is not None:
            yield _digest_rows([row()])

    dealt = formatted.select(F.col(conv).cast("long").alias("conv"), *order, "role", "text", "piece", "loss_start", "loss_end")
    dealt = dealt.repartition("conv").sortWithinPartitions("conv", *order, "role", "text")
    return dealt.select("conv", "piece", "loss_start", "loss_end").mapInPandas(run, shape)


def _digest_rows(rows: list[list]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
    return out.astype({"conv_id": "Int64"})
