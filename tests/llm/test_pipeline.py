"""The pipeline's stages against plain versions of their decisions."""

import collections
import math
import re

import corpus_pipeline
import public_tokenizers
from palimpsest.llm import quality
from tokenizers import Tokenizer

from .test_operators import brute_near, brute_tiles

SMALL = "/root/testdata/sf0.001"


def plain_statistics(text):
    """The statistics of a text, one character or word at a time."""
    data = text.encode()
    n, words, lines = max(1, len(data)), text.split(), text.split("\n")
    w = max(1, len(words))
    count = lambda chars: sum(chr(b) in chars for b in data)
    upper, lower, digits = (sum(a <= b <= z for b in data) for a, z in ((65, 90), (97, 122), (48, 57)))
    return [
        math.log(len(data) + 1), math.log(len(words) + 1), n / w, upper / max(1, upper + lower), len([x for x in words if x.isupper()]) / w, digits / n, count("!") / n, count("|") / n,
        count("#$%&*<>{}[]=+~^@\\") / n, count(".,;:?") / n, sum(b > 127 for b in data) / n, count(" \n\t\r") / n, len(set(words)) / w,
        sum(words[i] == words[i + 1] for i in range(len(words) - 1)) / w, w / len(lines), len(set(lines)) / len(lines), (upper + lower) / n,
    ]


def plain_score(model, text):
    x, total = plain_statistics(text), model.prior
    for feature, threshold, leaf in zip(model.feature, model.threshold, model.leaf):
        at = 0
        while at < len(feature):
            at = 2 * at + (2 if x[feature[at]] > threshold[at] else 1)
        total += leaf[at - len(feature)]
    return 1 / (1 + math.exp(-total))


def contaminated(text, items):
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    x = words(text)
    for y in map(words, items):
        n = min(5, len(y))
        if y and {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} & {tuple(y[i : i + n]) for i in range(len(y) - n + 1)}:
            if sum(m[2] for m in brute_tiles(x, y, n)) / len(y) >= 0.6:
                return True
    return False


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    step, kept = docs, {r.doc_id: r for r in docs.collect()}
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, step, SMALL)
        out.write.parquet(f"file://{tmp_path}/{n}")
        step = spark.read.parquet(f"file://{tmp_path}/{n}")
        if name == "quality":
            model = quality.learn(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
            kept = {i: r for i, r in kept.items() if plain_score(model, r.text) >= 0.3}
        elif name == "near_duplicates":
            order = sorted(kept)
            roots = brute_near([kept[i].text for i in order], 5, 80)
            kept = {i: kept[i] for at, i in enumerate(order) if roots[at][1] == at}
        elif name == "decontamination":
            before = len(kept)
            kept = {i: r for i, r in kept.items() if not contaminated(r.text, items)}
            assert len(kept) < before
        assert sorted(r.doc_id for r in step.select("doc_id").collect()) == sorted(kept)
        if n < 3:
            assert step.columns == docs.columns
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {r.doc_id: list(r.ids) for r in step.collect()} == {i: tok.encode(r.text, add_special_tokens=False).ids for i, r in kept.items()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).select("doc_id", "ids_sha256").collect())) == sorted(map(tuple, step.select("doc_id", "ids_sha256").collect()))


def test_stages_take_odd_tables(spark, tmp_path):
    """Nulls, repeated ids and rows, an empty text, a very long one, clashing columns, and no rows at all."""
    good = "the people of this town said that they would like to see more of their own music and art in the park next summer. " * 3
    rows = [(1, good), (1, good), (2, good), (3, None), (None, good), (None, None), (4, ""), (5, good + " and more " * 20_000), (6, "!!! $$$ ### 777 " * 30), (1, "another text under the first id " * 4)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x", b"y", 0.5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, key string, seeds binary, score double")
    for table in (docs, docs.limit(0)):
        step = table
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, step, SMALL)
            path = f"file://{tmp_path}/{table is docs}{n}"
            out.write.parquet(path)
            step = spark.read.parquet(path)
            if n < 3:
                assert step.columns == docs.columns
        if table is not docs:
            assert step.count() == 0
    ids = collections.Counter(r.doc_id for r in spark.read.parquet(f"file://{tmp_path}/True1").collect())
    kept = {r.doc_id for r in spark.read.parquet(f"file://{tmp_path}/True0").collect()}
    assert all(n == 1 for i, n in ids.items() if i is not None) and (1 in ids) == (1 in kept) and not (2 in ids and 1 in ids)


def test_registered():
    import __spark_entry__ as e

    names = list(e.queries())
    assert [n for k in range(1, 11) for n in names if n.startswith(f"op{k}_")].__len__() == 10 and "pipeline" in names
