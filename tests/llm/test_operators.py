"""Each operator against a library, a brute-force twin or an exact round trip."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from palimpsest.llm import bpe, chat, licenses, neardup, quality, sitetree, tiling, tokencount, topk, warc
from palimpsest.sources.store import Store, shared_dir

EDGE = [
    None, "", "  ", " a", "a ", "\n", "a  b\t\tc", "▁▁x ▁", " \x00a", "ﬁ½ 中文 🙂👩‍👩‍👧 <s> </s> <0x0A>", "<|endoftext|>a <|endoftext|>b", "a\x1cb\x85d",
    "it's we'LL 'S", "a" * 3000 + " " * 555 + "b", "Ǆ ⅷ ² ٣x", "mit license MIT License", "word " * 20_000,
]


def docs(spark, texts, **more):
    """Documents with a clashing extra column, from texts; ids count from 0."""
    rows = [(i, t, "x", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, key string").repartition(3)


def mixed(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("ab \n\t'.é1　\x1c\x85▁") for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_token_counts_equal_the_library(spark):
    texts = EDGE + mixed(300, 1)
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in tokencount.token_counts(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        n = len(sp.encode(t or ""))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 4096)


def test_bpe_equals_the_library_and_decodes(spark):
    texts = EDGE + mixed(300, 2)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coded = bpe.encode(docs(spark, texts))
    got = {r.doc_id: r for r in coded.collect()}
    back = {r.doc_id: r.text for r in bpe.decode(coded).collect()}
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert list(got[i].ids) == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert back[i] == tok.decode(ids, skip_special_tokens=False)


def test_pair_index_merges_each_word_like_itself():
    c = bpe.Codec(public_tokenizers.path("byte_bpe_50k.json"))
    words = [" the", "aaaaaaa", "abab", "", "é", "thethethe"]
    assert c.encode_words(words) == [c.encode_words([w])[0] for w in words]


def test_license_base_phrases(spark):
    texts = ["MIT License, mit license! x", "cc  by\ncc BY-SA", "gnu general publiclicense", "é mit license é", None, "", "mit. license. gnu general public license version 3", "mit license " * 5000] + [
        " ".join(random.Random(s).choice(["mit", "license", "apache", "cc", "by", "gnu", "general", "public", "é", "x."]) for _ in range(60)) for s in range(60)
    ]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        want = [(k, b) for p, b in licenses.BASE for k in range(len(ws)) if ws[k : k + len(p.split())] == p.split()]
        found = [(d.first_word, d.label) for d in got[i].detections if d.rule.startswith("base:")]
        assert got[i].n_words == len(ws) and sorted(found) == sorted(want)


def test_license_suppression():
    rules = licenses.rules()
    assert len(rules) > 200
    kept = [d[1] for d in licenses.detect(licenses.line_of("Licensed under the Apache License, Version 2.0"), rules) if d[6]]
    assert set(kept) == {"apache-2.0"}


def brute_top(rows, every, k):
    out = set()
    for q, x in rows:
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), c) for c, y in rows if c != q and len(y) == len(x))[:k]
            out |= {(q, n, c, -s) for n, (s, c) in enumerate(best, 1)}
    return out


def test_topk_equals_brute_force(spark):
    r = random.Random(3)
    rows = [(i, [r.choice([-3.0, -1.0, 0.0, 0.5, 2.0]) for _ in range(9)]) for i in range(300)]
    for i in range(100, 200):
        rows[i] = (i, rows[100][1])  # a hot vector
    bad = [(1000, None), (1020, [float("nan")] * 9), (1040, [None] * 9), (1060, [float("inf")] + [0.0] * 8), (None, [1.0] * 9), (1080, [1.0, 2.0])]
    df = spark.createDataFrame([(i, x, 1) for i, x in rows + bad], "vec_id long, embedding array<double>, rank int")
    v = topk.whole(df)
    got = topk.top_k(v.where("vec_id % 20 = 0"), v, 20)
    whole = [(i, [int(np.floor(64 * c)) for c in x]) for i, x in rows] + [(1080, [64, 128])]
    assert {tuple(x) for x in got.select("query_id", "rank", "vec_id", "score").collect()} == brute_top(whole, 20, 20)


@pytest.mark.parametrize("n,d,most", [(60, 8, 3), (3000, 64, 64), (7, 1, 9), (2500, 20, 2**30)])
def test_search_is_exact(n, d, most):
    r = np.random.default_rng(n)
    c = r.integers(-most, most, (n, d))
    c[: n // 3] = c[0]
    ids = r.permutation(n)
    pick = r.choice(n, min(30, n), False)
    i, found, score = topk.search(c[pick], ids[pick], c, ids, 20)
    s = c[pick] @ c.T
    kth = np.array([sorted(s[a, b] for b in range(n) if ids[b] != ids[pick][a])[-20:][0] for a in range(len(pick))], dtype=float)
    barred = topk.search(c[pick], ids[pick], c, ids, 20, kth)
    assert [x.tolist() for x in barred] == [x.tolist() for x in (i, found, score)]
    want = [(a, x, -y) for a in range(len(pick)) for y, x in sorted((-s[a, b], ids[b]) for b in range(n) if ids[b] != ids[pick][a])[:20]]
    assert list(zip(i, found, score)) == want


def test_cells_are_bounded_by_components(spark, monkeypatch):
    """Long vectors make small cells; the answer is the same from many of them."""
    sizes = []
    meet = topk._meet
    monkeypatch.setattr(topk, "MOST_COMPONENTS", 400)
    monkeypatch.setattr(topk, "_meet", lambda q, c, across, down, k: sizes.append((across, down)) or meet(q, c, across, down, k))
    r = random.Random(1)
    rows = [(i, [r.randint(-9, 9) for _ in range(40)]) for i in range(60)]
    v = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    got = topk.top_k(v.where("vec_id % 3 = 0"), v, 5)
    assert {tuple(x) for x in got.collect()} == brute_top(rows, 3, 5) and sizes == [(1, 2), (6, 2)]


def test_archive_round_trip(spark):
    big, small = "é" * 600, "x" * 999
    rows = [(1, "http://a/1", big), (2, None, big), (9, "http://a/9\r\nX: y", big), (3, "u", small), (4, "u", small), (5, "u", None), (6, "u", ""), (9, "http://a/9", big), (None, "u", big), (7, "u", "a\r\n\r\nb")]
    df = spark.createDataFrame([(a, b, c, "z") for a, b, c in rows], "page_id long, url string, html string, address string")
    path = f"{shared_dir(spark)}/a"
    warc.write_archive(df, path)
    out = warc.read_archive(spark, path).collect()
    assert len(out) == len(rows)
    assert spark.read.parquet(f"{path}/payloads").count() == len({c or "" for _, _, c in rows})
    by = collections.Counter((r.page_id, r.record_type, r.refers_to) for r in out)
    assert by == collections.Counter([(1, "revisit", 9), (2, "revisit", 9), (9, "response", None), (9, "response", None), (None, "response", None)] + [(i, "response", None) for i in (3, 4, 5, 6, 7)])
    for r in out:
        head, _, block = bytes(r.record).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and block.endswith(b"\r\n\r\n")
        assert int(re.search(rb"Content-Length: (\d+)", head)[1]) == len(block) - 4
        assert hashlib.sha1(bytes(r.payload)).hexdigest() == r.named_digest
        if r.record_type == "response":
            assert block[:-4] == bytes(r.payload)
    warc.export_warc(spark, path, f"{path}/files")
    assert spark.read.format("binaryFile").load(f"{path}/files/*.gz").count() > 0


def test_chat_template_is_reversible():
    r = random.Random(0)
    for _ in range(3000):
        turns = [
            (r.choice(["user", "assistant", "system", "User", "", "a: b", "=x", "t\\"]), "".join(r.choice(["\\", "#", "##", "###", "</turn>", "\n", ": ", "x"]) for _ in range(r.randint(0, 9))))
            for _ in range(r.randint(0, 4))
        ]
        text, spans = chat.render(turns)
        assert chat.parse(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t for role, t in turns if role == "assistant"]


def test_chat_masks_cover_assistant_texts(spark):
    rows = [(1, 1, "assistant", " héllo 🙂👩‍👩‍👧 "), (1, 0, "user", chat.HARD), (1, 2, None, None), (2, 0, "assistant", chat.HARD), (2, 0, "assistant", chat.HARD), (3, 0, "assistant", ""), (4, None, "system", "a" * 5000)]
    rows += [(5, i, "assistant" if i % 2 else "user", f"é{i} 🙂") for i in range(30)]
    loose = [("user", "<|endoftext|>"), ("assistant", "x"), ("assistant", "x"), (None, None)]
    df = spark.createDataFrame([(*x, 1) for x in rows] + [(None, 0, *x, 1) for x in loose], "conv_id long, turn long, role string, text string, rendered int")
    out = chat.format_chats(df).collect()
    got = {r.conv_id: r for r in out if r.conv_id is not None}
    assert set(got) == {1, 2, 3, 4, 5}
    own = [chat.parse(r.rendered) for r in out if r.conv_id is None]
    assert sorted(own) == sorted([(ro or "", x or "")] for ro, x in loose)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False)
    for r in out:
        code = tok.encode(r.rendered, add_special_tokens=False)
        assert list(r.token_ids) == code.ids
        spans = chat.render(chat.parse(r.rendered))[1]
        assert [(s.first, s.end) for s in r.loss_spans] == spans
        for (s, e), t in zip(spans, r.loss_tokens):  # every token that shares a character with the text, by trying all
            assert set(range(t.first, t.end)) == {i for i, (a, b) in enumerate(code.offsets) if a < e and b > s and e > s}
    for c, r in got.items():
        turns = sorted(((t if t is not None else -1, ro or "", x or "") for k, t, ro, x in rows if k == c))
        assert chat.parse(r.rendered) == [(ro, x) for _, ro, x in turns]
        said = "".join(chat.unescape(r.rendered[s.first : s.end]) for s in r.loss_spans)
        assert said == "".join(x for _, ro, x in turns if ro == "assistant")


def brute_near(texts, n, percent):
    fold = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    sets = {}
    for i, t in enumerate(texts):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", fold(t)) if x]
        sets[i] = {tuple(w[a : a + n]) for a in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def near_texts(seed):
    r = random.Random(seed)
    base = [[f"w{r.randint(0, 400)}" for _ in range(r.randint(1, 120))] for _ in range(25)]
    out = [None, "", " \n", "one", "ONE", "one two", "One Two"]
    for w in base:
        for _ in range(r.randint(1, 14)):
            c = list(w)
            for _ in range(r.randint(0, 4)):
                c[r.randrange(len(c))] = f"x{r.randint(0, 9)}"
            out.append(" ".join(c))
    return out


@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, n, percent):
    texts = near_texts(n)
    got = {r.doc_id: r for r in neardup.components(docs(spark, texts), n, percent).collect()}
    want = brute_near(texts, n, percent)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_near_duplicates_of_odd_tables(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "a b c d"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.component_id, r.kept) for r in neardup.components(df).collect())
    assert got == {(1, 1, True): 2, (2, 1, False): 1, (None, None, True): 2}
    assert collections.Counter(r.doc_id for r in neardup.keep_one(df).collect()) == {1: 1, None: 2}
    assert neardup.components(df.limit(0)).count() == 0


def test_near_duplicates_keep_all_links_of_a_repeated_id(spark):
    r = random.Random(1)
    a, b = ([f"{c}{r.randint(0, 9)}{i}" for i in range(60)] for c in "ab")
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a[:-1], "x"])), (3, " ".join([*b[:-1], "x"])), (4, "c c c"), (1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x.doc_id, x.component_id, x.kept) for x in neardup.components(df).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)}
    kept = [sorted((x.doc_id, x.text or "") for x in neardup.keep_one(df.repartition(p), 3, 85).collect()) for p in (1, 5)]
    assert kept[0] == kept[1] and [i for i, _ in kept[0]] == [1, 4]


@pytest.mark.parametrize("group", [2, 7, 1000])
def test_blocks_of_a_hot_bucket_lose_no_pair(spark, group):
    """Sets that share a bucket but no component: every pair above the threshold must be found."""
    r = random.Random(group)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for _ in range(40):
        c = list(base)
        for _ in range(r.randint(0, 4)):
            c[r.randrange(100)] = f"x{r.randint(0, 9)}"
        texts.append(" ".join(c))
    store = Store(spark)
    sets = store.save(neardup.shingle_sets(spark.createDataFrame([(t,) for t in texts], "text string"), 3).dropDuplicates(["key"]))
    rows = {bytes(x.key): set(x["items"]) for x in sets.collect()}
    mixed = store.save(sets.select(F.lit(5).cast("long").alias("bucket"), "key", F.size("items").alias("n"), F.col("key").alias("comp")))
    found = {frozenset((bytes(x.a), bytes(x.b))) for x in neardup.apart_pairs(store, mixed, sets, 85, group).collect()}
    near = {frozenset((a, b)) for a in rows for b in rows if a < b and 100 * len(rows[a] & rows[b]) >= 85 * len(rows[a] | rows[b])}
    assert near and near <= found and len(found) < len(rows) * (len(rows) - 1) / 2


def test_super_minhash_follows_its_definition():
    r = np.random.default_rng(0)
    sets = [r.integers(0, 2**63, n).astype(np.uint64) for n in (1, 3, 60, 0, 400)]
    got = neardup.super_minhash(np.concatenate(sets), np.repeat(np.arange(5), [len(s) for s in sets]), 5, 30)
    for row, s in zip(got, sets):
        h = [np.iinfo(np.int64).max] * 30
        for e in s:
            p = list(range(30))
            for j in range(30):
                draw = int(neardup.mix(np.array([e]) + np.array([j + 1], np.uint64) * neardup.A)[0])
                k = j + ((draw & 0xFFFFFFFF) * (30 - j) >> 32)
                p[j], p[k] = p[k], p[j]
                h[p[j]] = min(h[p[j]], j << 32 | draw >> 32)
        assert list(row) == h


def test_quality_on_the_held_out_fold(spark):
    d = "/root/testdata/sf0.01"
    got = quality.query(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out")
    rows = got.collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95


def test_quality_of_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    df = docs(spark, EDGE)
    model = quality.learn(df, none)
    assert {r.s for r in df.select(quality.score(model).alias("s")).collect()} == {0.5}
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.learn(df, labels)
    assert all(0 <= r.s <= 1 for r in df.select(quality.score(model).alias("s")).collect())


def test_trees_walk_like_a_loop():
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 5))
    y = (x[:, 1] * x[:, 2] > 0).astype(float)
    m = quality.fit(x, y)
    for row in range(20):
        total = m.prior
        for feature, threshold, leaf in zip(m.feature, m.threshold, m.leaf):
            at = 0
            for _ in range(m.depth):
                at = 2 * at + 1 + int(x[row, feature[at]] > threshold[at])
            total += leaf[at - (2**m.depth - 1)]
        assert abs(m.raw(x[row : row + 1])[0] - total) < 1e-9
    assert ((m.score(x) > 0.5) == y).mean() > 0.9


def plain_fit(x, y, trees, depth, bins, rate, ridge, least):
    """Boosted trees with plain loops: each node tries every cut of every statistic."""
    n, width = len(x), len(x[0])
    edges = [sorted(set(np.quantile([r[f] for r in x], [b / bins for b in range(1, bins)]))) for f in range(width)]
    mean = sum(y) / n
    prior = math.log(mean / (1 - mean))
    raw = [prior] * n

    def grow(rows, g, h, level):
        G, H = sum(g[i] for i in rows), sum(h[i] for i in rows)
        if level == depth:
            for i in rows:
                raw[i] += -rate * G / (H + ridge)
            return
        best = (1e-9, None)
        for f in range(width):
            for cut in edges[f]:
                left = [i for i in rows if x[i][f] <= cut]
                gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                if hl < least or H - hl < least:
                    continue
                gain = gl**2 / (hl + ridge) + (G - gl) ** 2 / (H - hl + ridge) - G**2 / (H + ridge)
                if gain > best[0] + 1e-12:
                    best = (gain, (f, cut))
        if best[1] is None:
            return grow(rows, g, h, level + 1)
        f, cut = best[1]
        for side in ([i for i in rows if x[i][f] <= cut], [i for i in rows if x[i][f] > cut]):
            grow(side, g, h, level + 1)

    for _ in range(trees):
        p = [1 / (1 + math.exp(-v)) for v in raw]
        grow(range(n), [a - b for a, b in zip(p, y)], [a * (1 - a) for a in p], 0)
    return raw


@pytest.mark.parametrize("seed", range(3))
def test_fit_equals_plain_boosting(seed):
    r = np.random.default_rng(seed)
    x = r.normal(size=(90, 4)).round(seed + 1)  # with ties
    y = ((x[:, 0] > 0) ^ (x[:, 1] * x[:, 2] > 0.3)).astype(float)
    settings = {"trees": 6, "depth": 3, "bins": 8, "rate": 0.3, "ridge": 1.0, "least": 0.5}
    model = quality.fit(x, y, **settings)
    assert np.allclose(model.raw(x), plain_fit(x.tolist(), y.tolist(), **settings), atol=1e-9)


PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/">x</a></ul></nav>'
    '<div class="ad">buy</div><article><h1>A &amp;amp; B</h1><p><b>one<br>two<p>three\n\n four&nbsp;five<form><input>q</form><div class="comments"><p>nice</div></article><aside>s</aside><footer>f</footer>'
)


def test_html_main_text():
    assert sitetree.main_text(PAGE) == "A &amp; B\n\none two\n\nthree four five"
    assert sitetree.main_text("") == "" and sitetree.main_text("plain <b>text") == "plain text"
    assert sitetree.main_text("<table><tr><td>a<td>b<tr><td>c</table><ul><li>1<li>2</ul>") == "a b\n\nc\n\n1\n\n2"
    assert sitetree.main_text("<ul><li>a<ul><li>b</ul><li>c</ul></p></x>d<p>e<div>f</div>g") == "a\n\nb\n\nc\n\nd\n\ne\n\nf\n\ng"


def test_long_and_deep_pages_take_linear_time():
    for tag, times in (("<b class=x>", 200_000), ("<div>", 30_000), ("<p><b>", 30_000), ("</b>", 30_000), ("<li>", 30_000), ("<article><p>", 30_000)):
        page = f"{tag} w" * times
        begun = time.perf_counter()
        nodes = sitetree.parse(page)
        found = sitetree.styles(nodes)
        assert sitetree.main_text(page).split() == ["w"] * times
        assert time.perf_counter() - begun < 30 and len(found) < 2000


def brute_tree(pages):
    """(host, path) -> presentation and content importance, from plain lists per page."""
    seen = collections.defaultdict(lambda: ([], []))
    for host, page in pages:
        by_path = collections.defaultdict(lambda: ([], []))

        def walk(node):
            texts, tags = [], []
            for k in node.kids:
                if isinstance(k, str):
                    texts += [" ".join(k.split())] if k.split() else []
                else:
                    tags.append(k.tag)
                    texts += walk(k)
            if node.tag not in ("#root", "html", "body"):
                by_path[node.path][0].insert(0, tuple(tags))
                by_path[node.path][1].insert(0, texts)
            return texts

        root = sitetree.parse(page)[0]
        order = []

        def visit(node):
            order.append(node)
            for k in node.kids:
                if not isinstance(k, str):
                    visit(k)

        visit(root)
        walk(root)
        for path in {n.path for n in order if n.tag not in ("#root", "html", "body")}:
            here = [n for n in order if n.path == path]
            flat = lambda n: [x for k in n.kids for x in ([" ".join(k.split())] if isinstance(k, str) and k.split() else [] if isinstance(k, str) else flat(k))]  # noqa: B023, E731
            seen[host, path][0].append(tuple(tuple(k.tag for k in n.kids if not isinstance(k, str)) for n in here))
            seen[host, path][1].append(tuple(x for n in here for x in flat(n)))
    entropy = lambda xs: 1.0 if len(xs) == 1 else -sum(c / len(xs) * math.log(c / len(xs)) for c in collections.Counter(xs).values()) / math.log(len(xs))
    return {k: (len(a), round(entropy(a), 9), round(entropy(b), 9)) for k, (a, b) in seen.items()}


def test_style_tree_equals_brute_force(spark):
    r = random.Random(2)
    bit = lambda: r.choice(["<p>a", "<p>b</p>", "<div class=x>a", "<div class='x y'><b>c</b></div>", "<ul><li>1<li>2</ul>", "t", "<nav>n</nav>"])
    pages = [(f"h{r.randint(0, 2)}.example", "<body>" + "".join(bit() for _ in range(r.randint(0, 6)))) for _ in range(80)]
    df = spark.createDataFrame([(i, f"http://{h}/", t) for i, (h, t) in enumerate(pages)], "page_id long, url string, html string").repartition(3)
    tree = sitetree.style_tree(sitetree.page_styles(sitetree._keyed(df, "page_id", "url", "html"))).collect()
    want = brute_tree(pages)
    assert {(x.host, x.path): (x.pages, round(x.presentation, 9) + 0.0, round(x.content, 9) + 0.0) for x in tree} == {k: (n, a + 0.0, b + 0.0) for k, (n, a, b) in want.items()}
    assert all(abs(x.importance - (0.9 * x.content + 0.1 * x.presentation)) < 1e-12 for x in tree)


def test_style_tree_removes_what_a_site_repeats(spark):
    body = lambda i: f'<html><body><div class="top">Welcome to us</div><div class="text"><p>Story {i} is its own</p></div><div class="low">All our pages say so</div></body></html>'
    rows = [(i, f"http://S.example/{i}", body(i), 1) for i in range(20)] + [(100, None, None, 1), (101, "x", "", 1), (102, "http://one.example/", body(7), 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    got = {r.page_id: r.text for r in sitetree.extract(df).collect()}
    assert all(got[i] == f"Story {i} is its own" for i in range(20))
    assert got[100] == "" and got[101] == "" and got[102].count("\n\n") == 2
    same = spark.createDataFrame([(i, "http://t.example/", PAGE) for i in range(30)], "page_id long, url string, html string")
    assert {r.text for r in sitetree.extract(same).collect()} == {sitetree.main_text(PAGE)}


def test_style_tree_decides_inside_a_main_element(spark, monkeypatch):
    """A box alike in all articles goes; a repeated article, its headings and paragraphs stay; so does a box that differs."""
    page = lambda i: f"<article><h1>Our title</h1><div class=k>Follow us everywhere</div><p>Story {i}</p><p>The end.</p><div class=own>Box {i}</div></article>"
    rows = [(i, "http://a.example/", page(i)) for i in range(20)] + [(i, "http://b.example/", page(1)) for i in range(20, 60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in sitetree.extract(df).collect()}
    assert all(got[i] == f"Our title\n\nStory {i}\n\nThe end.\n\nBox {i}" for i in range(20))
    assert all(got[i] == "Our title\n\nFollow us everywhere\n\nStory 1\n\nThe end.\n\nBox 1" for i in range(20, 60))
    noise = sitetree.noise_of
    monkeypatch.setattr(sitetree, "noise_of", lambda *a: noise(*a).limit(0))
    assert {r.page_id: r.text for r in sitetree.extract(df).collect()}[3].count("Follow us") == 1


def test_tiling_catches_reordered_passages(spark):
    r = random.Random(5)
    word = lambda: f"w{r.randint(0, 5000)}"
    items = [[word() for _ in range(n)] for n in (60, 40, 3, 12)]
    noise = lambda n: [word() for _ in range(n)]
    a, b = items[0], items[1]
    texts = [
        " ".join(noise(30) + a[30:] + noise(9) + a[:30] + noise(5)), " ".join(x.upper() + "," for x in b), " ".join(noise(500)), None, "", " ".join(items[2]),
        " ".join(a[:20] + noise(50)), " ".join(b + noise(5) + b), " ".join(items[3][:6] + noise(3) + items[3][6:]), " ".join(b), " ".join(noise(20_000) + a + noise(20_000)),
    ]
    bench = spark.createDataFrame([(i, " ".join(x), 0) for i, x in enumerate(items)] + [(9, None, 0), (10, "", 0), (0, " ".join(a), 1)], "item_id long, text string, doc_id int")
    got = collections.Counter((x.doc_id, x.item_id, x.coverage) for x in tiling.contaminations(docs(spark, texts), bench).collect())
    assert got == {(0, 0, 1.0): 2, (1, 1, 1.0): 1, (5, 2, 1.0): 1, (7, 1, 1.0): 1, (8, 3, 1.0): 1, (9, 1, 1.0): 1, (10, 0, 1.0): 2}
    left = tiling.clean(docs(spark, texts), bench)
    assert left.columns == ["doc_id", "text", "n_tokens", "key"] and {x.doc_id for x in left.collect()} == {2, 3, 4, 6}
    assert tiling.contaminations(docs(spark, texts), bench.limit(0)).count() == 0 and tiling.clean(docs(spark, texts), bench.limit(0)).count() == 11


def brute_tiles(doc, item, least):
    """The first longest common run of unmarked words again and again, by trying all."""
    fd, fi, out = [True] * len(doc), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                e = 0
                while i + e < len(doc) and j + e < len(item) and doc[i + e] == item[j + e] and fd[i + e] and fi[j + e]:
                    e += 1
                if e > best[0]:
                    best = (e, i, j)
        e, i, j = best
        if e < least:
            return out
        fd[i : i + e], fi[j : j + e] = [False] * e, [False] * e
        out.append((i, j, e))


def shuffled_texts(r, n_items, n_docs):
    """Items over a small vocabulary, and documents made of pieces of them: many ties and overlaps."""
    items = [[f"v{r.randint(0, 30)}" for _ in range(r.choice([2, 4, 5, 9, 25, 40]))] for _ in range(n_items)]
    docs = []
    for _ in range(n_docs):
        d = []
        while len(d) < r.randint(0, 90):
            it = r.choice(items)
            a = r.randrange(len(it))
            d += it[a : a + r.randint(1, 20)] + ["wall"] * r.randint(0, 1)
        docs.append(d)
    return items, docs


def test_tiles_equal_brute_force():
    r = random.Random(8)
    for _ in range(400):
        alphabet = r.choice([2, 5, 40])
        item = [r.randrange(1, alphabet + 1) for _ in range(r.randint(1, 40))]
        doc = []
        while len(doc) < 60:
            a = r.randrange(len(item))
            doc += item[a : a + r.randint(1, 12)] + [0] * r.randint(0, 1)
        least = r.choice([1, 2, 3, 5])
        if least <= len(item):
            assert tiling.tiles(np.array(doc), np.array(item), least) == brute_tiles(doc, item, least)


def test_contaminations_equal_brute_force(spark):
    items, texts = shuffled_texts(random.Random(4), 25, 60)
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string").repartition(3)
    got = {(x.doc_id, x.item_id): (round(x.coverage, 9), x.n_tiles, x.longest_tile, x.first_word) for x in tiling.contaminations(docs(spark, [" ".join(t) for t in texts]), bench).collect()}
    want = {}
    for d, t in enumerate(texts):
        for i, x in enumerate(items):
            found = brute_tiles(t, x, min(5, len(x)))
            if sum(m[2] for m in found) / len(x) >= 0.6:
                want[d, i] = (round(sum(m[2] for m in found) / len(x), 9), len(found), max(m[2] for m in found), min(m[0] for m in found))
    assert len(want) > 50 and got == want


def test_repetitive_texts_are_tiled_in_time():
    begun = time.perf_counter()
    same = np.ones(20_000, np.int64)
    assert tiling.tiles(same, same[:3000], 5) == [(0, 0, 3000)]
    assert time.perf_counter() - begun < 30


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert tokencount.token_counts(d).count() == bpe.encode(d).count() == licenses.scan(d).count() == 0
    p = spark.createDataFrame([], "page_id long, url string, html string")
    assert sitetree.extract(p).count() == 0
    path = f"{shared_dir(spark)}/e"
    warc.write_archive(p, path)
    assert warc.read_archive(spark, path).count() == 0
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    v = topk.whole(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.top_k(v, v).count() == 0


def test_null_ids_pass(spark):
    d = spark.createDataFrame([(None, "mit license"), (None, None)], "doc_id long, text string")
    for out in (tokencount.token_counts(d), bpe.encode(d), licenses.scan(d), d.select("doc_id", F.lit(1))):
        assert [r.doc_id for r in out.collect()] == [None, None]
