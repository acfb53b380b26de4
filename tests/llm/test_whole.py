"""Queries that must do the whole job where a shortcut would lose rows."""

import random
import re

import duckdb
import pytest

from palimpsest.llm import licenses, warc

SMALL = "/root/testdata/sf0.001"


def sample(pattern: str, options: bool) -> str:
    """A text that the pattern of a licence rule matches, with or without what is optional."""
    p = re.sub(r"\(\?!.*?\)\)", "", pattern)
    p = re.sub(r"\(\?:([^()|]*)[^()]*\)\?", r"\1" if options else "", p)
    p = re.sub(r"\(\?:([^()|]*)[^()]*\)", r"\1", p)
    return re.sub(r"\.\{[^}]*\}\?", "some one", re.sub(r"\[(.)[^]]*\]", r"\1", p))


@pytest.mark.parametrize("options", [False, True])
def test_every_license_rule_runs(options):
    signatures = licenses.rules()
    for rule, *_, key, rx in signatures:
        text = sample(rx.pattern.decode().removeprefix("(?<![^ ])(?:").removesuffix(")(?![^ ])"), options)
        assert re.fullmatch(rb"[a-z0-9]+( [a-z0-9]+)*", key), rule
        assert rule in {d[0] for d in licenses.detect(licenses.line_of(text), signatures)}, (rule, text)


@pytest.mark.parametrize(
    "text,labels",
    [
        ("Licensed under CC BY-NC 4.0", "cc-by,cc-by-nc"), ("cc by nc", "cc-by,cc-by-nc"), ("CC BY-NC 4", "cc-by,cc-by-nc"), ("CC-BY 4.0", "cc-by"), ("cc by nc sa", "cc-by,cc-by-nc-sa"), ("CC BY-ND 4.0", "cc-by,cc-by-nd"),
        ("CC BY-SA 3.0 and CC BY 2.0", "cc-by,cc-by-sa"), ("cc by nc nd 4.0", "cc-by,cc-by-nc-nd"), ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0", "cc-by-nc-sa"), ("GNU General Public License, version 3 or so", "gpl,gpl-3.0"),
        ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2.0-or-later"), ("Licensed under the Apache License, Version 2.0", "apache,apache-2.0"), ("the limit license of submit", ""), ("This is the MIT license.", "mit"), ("New BSD License", "bsd-3-clause"),
    ],
)
def test_license_labels(text, labels):
    found = licenses.detect(licenses.line_of(text), licenses.rules())
    assert ",".join(sorted({d[1] for d in found if d[6] or d[0].startswith("base:")})) == labels


def plain_kept(found):
    """A detection goes if another of the same or a better priority, found before it in order, holds its place."""
    order = sorted(found, key=lambda d: (d[4], -d[5], d[2], d[0]))
    return [not any(o[2] <= d[2] and o[4] <= d[4] and o[5] >= d[5] for o in order[:n]) for n, d in enumerate(order)], order


def test_license_suppression_equals_all_pairs():
    r = random.Random(3)
    rules = licenses.rules()
    bits = ["cc by nc sa", "cc by", "apache license version 2 0", "licensed under the apache license", "2 0", "gnu general public license version 2", "or later", "mit license", "license mit", "x", "all rights reserved", "spdx license identifier mit"]
    for _ in range(300):
        found = licenses.detect(licenses.line_of(" ".join(r.choice(bits) for _ in range(r.randint(1, 9)))), rules)
        kept, order = plain_kept(found)
        assert [d[6] for d in order] == kept


def test_archive_query_reads_whole_records(spark, monkeypatch):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{SMALL}/pages.parquet'")
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert {tuple(r) for r in warc.query(spark, SMALL).select(*cols).collect()} == set(c.execute(f"SELECT {', '.join(cols)} FROM ({warc.ORACLE})").fetchall())
    read = warc.read_archive
    monkeypatch.setattr(warc, "read_archive", lambda *a: read(*a).selectExpr("* EXCEPT (record)", "substring(record, 2) AS record"))
    with pytest.raises(Exception, match="not as long"):
        warc.query(spark, SMALL).collect()
