"""Token counts by heap-and-linked-list byte-pair merging (operator 3).

A text is cut at its spaces: no piece of the vocabulary holds a space mark after its first
other character, so no merge crosses such a cut and counts add up. Within a cut, a heap
gives the best adjacent pair, a linked list joins its neighbours, and the count is the
number of first symbols less the number of merges. No ids are made.

A model that is no byte-pair model, or that normalizes texts, is refused.

Nulls and empty texts count 0 tokens. Repeated rows are counted each by itself.
"""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush
from itertools import chain

import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm._base import Recent, map_rows, table, text_of

NAME = "op3_token_counts"
MODEL = "piece_bpe_32k.model"
LIMIT = 4096
MARK = "▁"


class Counter:
    """Counts what sentencepiece's BPE would emit for a text, without special tokens."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        self.rank = {
            sp.id_to_piece(i): -sp.get_score(i)
            for i in ids
            if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))
        }
        self.by_bytes = any(sp.is_byte(i) for i in ids)
        if sp.normalize("ﬁ  ½ e\u0301 ") != f"{MARK}ﬁ{MARK}{MARK}½{MARK}e\u0301{MARK}":
            raise ValueError(f"{path}: a model that changes texts before it cuts them can't be counted by word")
        if any(not r.is_integer() for r in self.rank.values()):
            raise ValueError(f"{path}: the pieces have no ranks: not a byte-pair model")
        if any(MARK in p.lstrip(MARK) or any(c not in self.rank for c in p) for p in self.rank):
            raise ValueError(f"{path}: pieces that cross words or lack a character can't be counted by word")
        self.cache = Recent()

    def merged(self, word: str) -> int:
        """Tokens of one word with its space marks."""
        rank = self.rank
        sym: list = list(word)
        n = count = len(sym)
        if self.by_bytes:
            count += sum(len(c.encode()) - 1 for c in sym if c not in rank)
        heap = []
        for i in range(n - 1):
            pair = sym[i] + sym[i + 1]
            if pair in rank:
                heap.append((rank[pair], i, pair))
        if not heap:
            return count
        heapify(heap)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        while heap:
            _, i, pair = heappop(heap)
            j = after[i]
            if sym[i] is None or j >= n or sym[i] + sym[j] != pair:
                continue  # one of the two has merged since
            sym[i], sym[j] = pair, None
            count -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                new = pair + sym[k]
                if new in rank:
                    heappush(heap, (rank[new], i, new))
            p = before[i]
            if p >= 0:
                new = sym[p] + pair
                if new in rank:
                    heappush(heap, (rank[new], p, new))
        return count

    def words(self, text: str) -> list[str]:
        """The words of a text, each without the first of its space marks."""
        if not text:
            return []
        if MARK in text:  # the library reads its own mark as a space
            text = text.replace(MARK, " ")
        text = " " + text
        return text.split(" ")[1:] if "  " not in text else [w[1:] for w in re.findall(" +[^ ]*", text)]

    def count_batch(self, texts: list[str]) -> list[int]:
        cut = [self.words(t) for t in texts]
        known, new = self.cache.look(set(chain.from_iterable(cut)))
        found = {w: self.merged(MARK + w.replace(" ", MARK)) for w in new}
        self.cache.add(found)
        get = (known | found).__getitem__
        return [sum(map(get, c)) for c in cut]


def token_counts(
    df: DataFrame,
    model_path: str | None = None,
    limit: int = LIMIT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row of ``df``."""
    path = model_path or public_tokenizers.path(MODEL)

    def make():
        counter = Counter(path)

        def f(ids, texts):
            n = counter.count_batch(texts)
            return ids, [len(t.encode()) for t in texts], n, [x > limit for x in n]

        return f

    return map_rows(
        df,
        [F.col(id_col).cast("long"), text_of(text_col)],
        make,
        f"{id_col} long, n_bytes long, n_tokens long, over_limit boolean",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
