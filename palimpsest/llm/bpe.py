"""BPE encoding and decoding by a pair occurrence index (operator 7).

The distinct words of a batch that are not known yet form one partition. An index maps each
adjacent pair to all its positions there; active ranks are applied in ascending order, each
to its whole list of positions, and the lists of the neighbouring pairs are updated. Words
are independent, so the result is that of merging each word by itself.

Nulls and empty texts encode to no ids. Strings of the vocabulary's added tokens inside a
text become their ids, as is the library's default.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm._base import Recent, map_rows, table, text_of

NAME = "op7_bpe"
VOCAB = "byte_bpe_50k.json"
#: White space as the pattern's engine knows it, spelled out: it leaves out U+001C to U+001F.
SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PATTERN = public_tokenizers.PATTERN.replace("[^\\s\\p{L}", f"[^{SPACE}\\p{{L}}").replace("\\s", f"[{SPACE}]").replace("(?!\\S)", f"(?![^{SPACE}])")
#: A pair of ids as one number; marks in the array of ids.
SHIFT, WALL, GONE = 20, -1, -2
#: Words and pieces in a generation of the cache.
KNOWN = 120_000
#: White space that sends a text to the pattern itself.
ODD = "\x85\x1c\x1d\x1e\x1f"


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in kept}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return out


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        chars = byte_chars()
        back = {c: b for b, c in chars.items()}
        self.first = [vocab[chars[b]] for b in range(256)]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {vocab[a] << SHIFT | vocab[b]: r for r, (a, b) in enumerate(merges)}
        self.pair = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        self.start = np.array([*self.first[:255], WALL])
        self.byte_rank = np.full((256, 256), -1, np.int32)
        byte_of = {t: b for b, t in enumerate(self.first[:255])}
        for r, (a, b, _) in enumerate(self.pair):
            if a in byte_of and b in byte_of:
                self.byte_rank[byte_of[a], byte_of[b]] = self.rank[a << SHIFT | b]
        self.bytes = {i: bytes(back[c] for c in t) for t, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes |= {i: t.encode() for t, i in self.added.items()}
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pieces = regex.compile(PATTERN).findall
        self.cache = Recent(KNOWN)

    def encode_words(self, words: list[str]) -> list[tuple]:
        """Ids of each word, all words being merged together over one pair index."""
        rank, pairs = self.rank, self.pair
        # Bytes first: their pairs are ranked by a table, and each rank's positions are cut from one sort.
        code = np.frombuffer(b"".join([w.encode() + b"\xff" for w in words]), np.uint8)  # no UTF-8 has that byte
        tok, n = self.start[code].tolist(), len(code)
        ends = np.flatnonzero(code == 255).tolist()
        ranks = self.byte_rank[code[:-1], code[1:]]
        at = np.flatnonzero(ranks >= 0)
        at = at[np.argsort(ranks[at], kind="stable")]
        heap, cuts = np.unique(ranks[at], return_index=True)
        heap = heap.tolist()  # sorted, so a heap
        places, cuts = at.tolist(), [*cuts.tolist(), len(at)]
        where = {pairs[r][0] << SHIFT | pairs[r][1]: places[i:j] for r, i, j in zip(heap, cuts, cuts[1:])}
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        while heap:
            a, b, c = pairs[heappop(heap)]
            for i in sorted(where.pop(a << SHIFT | b)):
                j = after[i]
                if tok[i] != a or tok[j] != b:
                    continue  # merged since it was noted
                tok[i], tok[j] = c, GONE
                k = after[i] = after[j]
                before[k] = i
                t = tok[k]
                if t >= 0 and (p := c << SHIFT | t) in rank:
                    if p in where:
                        where[p].append(i)
                    else:
                        where[p] = [i]
                        heappush(heap, rank[p])
                h = before[i]
                if h >= 0 and (t := tok[h]) >= 0 and (p := t << SHIFT | c) in rank:
                    if p in where:
                        where[p].append(h)
                    else:
                        where[p] = [h]
                        heappush(heap, rank[p])
        at, out = 0, []
        for e in ends:
            out.append(tuple([x for x in tok[at:e] if x >= 0]))
            at = e + 1
        return out

    def learn(self, words: set[str]) -> dict[str, tuple]:
        """Ids of each word; the words that the cache lacks are encoded. A word may hold several pieces.

        One cache serves words and pieces: a piece is a word of one piece.
        """
        known, new = self.cache.look(words)
        whole, cut = set(), []
        for w in new:
            if w.isascii() and w.removeprefix(" ").isalpha():
                whole.add(w)  # letters are one piece
            elif len(c := self.pieces(w)) == 1 and c[0] == w:
                whole.add(w)
            else:
                cut.append((w, c))
        ids, fresh = self.cache.look(set(chain.from_iterable(c for _, c in cut)) - whole)
        fresh += whole
        found = dict(zip(fresh, self.encode_words(fresh)))
        ids |= found
        for w, c in cut:
            found[w] = tuple(chain.from_iterable(map(ids.__getitem__, c)))
        self.cache.add(found)
        known |= found
        return known

    def words(self, text: str) -> list[str]:
        """Cuts at single spaces, where a piece always begins; else the pattern's own pieces."""
        bare = text.split()
        if len("".join(bare)) + len(bare) - 1 != len(text) or any(c in text for c in ODD):  # a run of white space, or some at an end
            return self.pieces(text)
        first, *rest = text.split(" ")
        return [first, *[" " + w for w in rest]]

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        cut = []
        for t in texts:
            parts = self.split_added.split(t) if self.split_added and any(a in t for a in self.added) else [t]
            cut.append([(p in self.added and k % 2 == 1, p if k % 2 else self.words(p)) for k, p in enumerate(parts) if p])
        get = self.learn(set(chain.from_iterable(ws for c in cut for special, ws in c if not special))).__getitem__
        return [
            list(chain.from_iterable((self.added[ws],) if special else chain.from_iterable(map(get, ws)) for special, ws in c))
            for c in cut
        ]

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec_of(path: str) -> Codec:
    """One codec for all tasks of a worker: what it has learned serves the next task."""
    return Codec(path)


def encode(df: DataFrame, vocab_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids]) of every row of ``df``.

    ``ids`` is the encoding itself; ``decoded_sha256`` is of the text that decoding it gives.
    """
    path = vocab_path or public_tokenizers.path(VOCAB)

    def make():
        codec = codec_of(path)
        texts_of_ids = {i: str(i) for i in codec.bytes}

        def f(ids, texts):
            codes = codec.encode_batch(texts)
            digests = [hashlib.sha256(",".join(map(texts_of_ids.__getitem__, c)).encode()).hexdigest() for c in codes]
            back = [hashlib.sha256(codec.decode(c).encode()).hexdigest() for c in codes]
            return [ids, [len(c) for c in codes], digests, back] + [codes] * keep_ids

        return f

    return map_rows(
        df,
        [F.col(id_col).cast("long"), text_of(text_col)],
        make,
        f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids,
    )


def decode(df: DataFrame, vocab_path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from a column of ids; null ids decode to an empty text."""
    path = vocab_path or public_tokenizers.path(VOCAB)

    def make():
        codec = codec_of(path)
        return lambda keys, ids: (keys, [codec.decode(i or ()) for i in ids])

    return map_rows(df, [F.col(id_col).cast("long"), F.col(ids_col)], make, f"{id_col} long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), keep_ids=False)
