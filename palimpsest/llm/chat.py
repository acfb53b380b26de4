r"""Chat formatting with offset-aligned loss masks (operator 6).

A conversation is rendered whole, ``### Role: text</turn>`` per turn. Backslashes and the
template's own marks inside texts get a backslash, so the rendering can be read back. It is
encoded once, the bytes of its tokens giving their offsets; the spans of assistant texts, sorted,
are intersected with the token spans by binary search, and the tokens found form the loss mask.

Rows of a conversation are ordered by turn, then role, then text; repeated rows are turns of
their own. A null text or role is empty; each row without a conv_id is a conversation of its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from palimpsest.llm._base import map_rows, table
from palimpsest.llm.bpe import Codec, codec_of

NAME = "op6_chat_format"
VOCAB = "byte_bpe_50k.json"
TITLES = {"user": "User", "assistant": "Assistant", "system": "System"}
ROLES = {v: k for k, v in TITLES.items()}
SPECIAL = re.compile(r"\\|###|</turn>")
SPECIAL_ROLE = re.compile(r"\\|###|</turn>|:")
ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
#: Characters of rendered conversations that are encoded at once.
AT_ONCE = 1_000_000
MARKS = re.compile(r"\\(?:\\|###|</turn>|:)|### |: |</turn>\n")


def escape(text: str, special: re.Pattern = SPECIAL) -> str:
    return special.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as one text, and where its assistant texts stand in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head = f"### {TITLES.get(role) or '=' + escape(role, SPECIAL_ROLE)}: "
        body = escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        turn = f"{head}{body}</turn>\n"
        out.append(turn)
        at += len(turn)
    return "".join(out), spans


def parse(rendered: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    turns, role, at = [], None, 0
    for m in MARKS.finditer(rendered):
        mark = m.group()
        if role is None and mark == "### ":
            at = m.end()
        elif role is None and mark == ": ":
            name = rendered[at : m.start()]
            role = unescape(name[1:]) if name.startswith("=") else ROLES[name]
            at = m.end()
        elif role is not None and mark == "</turn>\n":
            turns.append((role, unescape(rendered[at : m.start()])))
            role = None
    return turns


def token_ranges(ends: np.ndarray, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """For each span, the tokens [first, end) that share a place with it; tokens lie end to end."""
    first = np.searchsorted(ends, [s for s, _ in spans], "right")
    last = np.searchsorted(ends, [e for _, e in spans], "left") + 1
    return [(int(a), int(b)) if e > s else (int(a), int(a)) for a, b, (s, e) in zip(first, last, spans)]


def masked(codec: Codec, sizes: np.ndarray, chats: list[tuple[str, list]]) -> list[tuple[list, list, list]]:
    """(ids, loss tokens, loss spans) of rendered conversations with the spans of their assistant texts.

    Tokens are runs of bytes, so spans are compared as bytes and told in code points.
    """
    out = []
    for ids, (text, spans) in zip(codec.encode_batch([t for t, _ in chats]), chats):
        ends = np.cumsum(sizes[np.array(ids, dtype=np.int64)])
        if text.isascii():
            at = lambda c: c
            back = at
        else:
            starts = np.cumsum([0, *map(len, map(str.encode, text))]) if len(spans) > 8 else None
            at = (lambda c: int(starts[c])) if starts is not None else (lambda c: len(text[:c].encode()))  # noqa: B023
            raw = text.encode()
            back = lambda b: len(raw[:b].decode("utf-8", "ignore"))  # noqa: B023, E731
        wide = [(at(s), at(e)) for s, e in spans]
        ranges = token_ranges(ends, wide) if len(ids) else [(0, 0)] * len(spans)
        covered = []
        for (s, e), (a, b) in zip(wide, ranges):
            covered.append((back(max(s, int(ends[a - 1]) if a else 0)), back(min(e, int(ends[b - 1])))) if b > a else (back(s), back(s)))
        out.append((ids, ranges, covered))
    return out


def format_chats(df: DataFrame, vocab_path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """(conv_id, rendered, loss_spans, loss_tokens[, token_ids]) of every conversation.

    ``loss_spans`` are [first, end) in code points of ``rendered``: what the masked tokens
    cover of assistant texts; ``loss_tokens`` are the ranges of masked tokens.
    """
    path = vocab_path or public_tokenizers.path(VOCAB)
    ddl = "conv_id long, rendered string, loss_spans array<struct<first: long, end: long>>, loss_tokens array<struct<first: long, end: long>>" + ", token_ids array<int>" * keep_ids
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        sizes = np.zeros(max(codec.bytes) + 1, dtype=np.int64)
        for i, b in codec.bytes.items():
            sizes[i] = len(b)
        pairs = lambda xs: [{"first": a, "end": b} for a, b in xs]

        def packed(convs, chats):
            rows = [[c, text, pairs(spans), pairs(tokens)] + [ids] * keep_ids for c, (text, _), (ids, tokens, spans) in zip(convs, chats, masked(codec, sizes, chats))]
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

        conv, turns, convs, chats, size = None, [], [], [], 0
        for batch in batches:
            for c, role, text in zip(*(x.to_pylist() for x in batch.columns)):
                if turns and (c is None or c != conv):
                    chats.append(render(turns))
                    convs.append(conv)
                    turns = []
                    size += len(chats[-1][0])
                    if size > AT_ONCE:
                        yield packed(convs, chats)
                        convs, chats, size = [], [], 0
                conv = c
                turns.append((role, text))
        if turns:
            chats.append(render(turns))
            convs.append(conv)
        if chats:
            yield packed(convs, chats)

    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"))
    # Rows without a conversation are dealt over all tasks.
    rows = rows.withColumn("alone", F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text")))
    return rows.repartition("conv_id", "alone").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(run, ddl)


#: The conversation that the query adds: its texts look like the template's own marks.
HARD = "\\### Assistant: </turn> ok"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-7, 0, "user", HARD), (-7, 1, "assistant", HARD)], "conv_id long, turn long, role string, text string")
    chats = format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own), keep_ids=False)

    def make():
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()

        def f(ids, texts, spans):
            turns = [parse(t) for t in texts]
            loss = ["".join(unescape(t[s["first"] : s["end"]]) for s in ss) for t, ss in zip(texts, spans)]
            whole = [sha("".join(f"{r}\n{x}\n" for r, x in ts)) for ts in turns]
            return ids, [len(ts) for ts in turns], whole, [len(x) for x in loss], [sha(x) for x in loss], [len(t) for t in texts]

        return f

    return map_rows(chats, ["conv_id", "rendered", "loss_spans"], make, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_TURNS = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{HARD}', NULL UNION ALL SELECT -7, 1, 'assistant', '{HARD}', NULL
), e AS (
  SELECT *, replace(replace(replace(text, '\\', '\\\\'), '###', '\\###'), '</turn>', '\\</turn>') AS body FROM c
)
"""
ORACLE = _TURNS + """
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(body) + length(role) + 4 + 2 + 8
    + CASE WHEN role IN ('user', 'assistant', 'system') THEN 0 ELSE 1 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id, alone
"""
