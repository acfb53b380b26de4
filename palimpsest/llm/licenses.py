"""License scans by ordered signature rules (operator 4).

A text becomes its words: A-Z lower-cased, words being runs of ASCII letters and digits and
of characters beyond ASCII, joined by one space. Each rule is a regular expression over that
line, tried only where its keyword occurs, which one automaton tells for all rules. Rules are ordered; of overlapping detections, one
that lies inside another of the same or a better priority is suppressed. Detections of the
four base phrases are always reported, and their labels stay.

A null text is empty and has no detections. Repeated rows are scanned each by itself.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm._base import map_rows, table, text_of

NAME = "op4_license_scan"
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: The rules, written by hand: label, priority, pattern over the words of a text. Priorities: 1 a
#: clause of the licence's own text, 2 a tag or a grant that names it, 3 its address, 4 its name,
#: 5 a loose mention.
RULES = """
mit                 1  permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit                 1  the above copyright notice and this permission notice shall be included in all copies or substantial portions
mit                 1  in no event shall the authors or copyright holders be liable for any claim damages or other liability
mit                 2  (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?mit licen[cs]e
mit                 2  spdx license identifier mit
mit                 2  license mit(?: license)?
mit                 3  opensource org licenses mit(?: license)?
mit                 4  (?:the )?(?:mit|expat) licen[cs]e(?: mit)?
mit                 4  mit x11 licen[cs]e
mit                 5  (?:dual )?licensed (?:as|with) mit
mit-0               1  permission is hereby granted free of charge to any person obtaining a copy of this software .{0,200}? to permit persons to whom the software is furnished to do so the software is provided
mit-0               2  spdx license identifier mit 0
mit-0               4  mit no attribution(?: license)?
x11                 1  except as contained in this notice the name of .{1,80}? shall not be used in advertising
x11                 2  spdx license identifier x11
x11                 4  x11 (?:license|style license)
isc                 1  permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that
isc                 2  spdx license identifier isc
isc                 3  opensource org licenses isc(?: license)?
isc                 4  isc licen[cs]e(?: isc)?
0bsd                1  permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
0bsd                2  spdx license identifier 0bsd
0bsd                4  (?:zero clause bsd|bsd zero clause|free public) license
bsd                 1  redistribution and use in source and binary forms with or without modification are permitted provided that
bsd                 1  redistributions of source code must retain the above copyright notice
bsd                 1  redistributions in binary form must reproduce the above copyright notice
bsd                 4  bsd (?:style )?licen[cs]e
bsd                 5  under (?:a|the) bsd style
bsd-2-clause        2  spdx license identifier bsd 2 clause
bsd-2-clause        3  opensource org licenses bsd 2 clause
bsd-2-clause        4  (?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd) license
bsd-3-clause        1  neither the name of .{1,120}? may be used to endorse or promote products derived from
bsd-3-clause        1  the name of the author may not be used to endorse or promote products
bsd-3-clause        2  spdx license identifier bsd 3 clause
bsd-3-clause        3  opensource org licenses bsd 3 clause
bsd-3-clause        4  (?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd) license
bsd-4-clause        1  all advertising materials mentioning features or use of this software must display the following (?:acknowledgement|acknowledgment)
bsd-4-clause        2  spdx license identifier bsd 4 clause
bsd-4-clause        4  (?:original bsd|bsd 4 clause|4 clause bsd) license
bsd-3-clause-clear  1  no express or implied licenses to any party s patent rights are granted by this license
apache-1.0          1  this product includes software developed by the apache group for use in the apache http server project
apache-1.1          1  the end user documentation included with the redistribution if any must include the following (?:acknowledgement|acknowledgment)
apache-1.1          2  spdx license identifier apache 1 1
apache-1.1          4  apache (?:software )?license (?:version )?1 1
apache-2.0          1  you may not use this file except in compliance with the license you may obtain a copy of the license at
apache-2.0          1  unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2.0          1  each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache-2.0          2  licensed under the apache license (?:version |v )?2 0
apache-2.0          2  spdx license identifier apache 2 0
apache-2.0          2  license apache (?:version )?2 0
apache-2.0          3  (?:www )?apache org licenses license 2 0(?: txt| html)?
apache-2.0          3  opensource org licenses apache 2 0
apache-2.0          4  apache (?:software )?license (?:version |v )?2 0
apache-2.0          4  apache license 2
apache-2.0          5  apache 2 0 licensed
apache              2  (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?apache licen[cs]e
apache              4  apache (?:software )?licen[cs]e
gpl                 1  you should have received a copy of the gnu general public license along with this program
gpl                 1  free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl                 1  the licenses for most software are designed to take away your freedom to share and change it
gpl                 2  (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl
gpl                 3  (?:www )?gnu org (?:licenses|copyleft) gpl(?: html| txt)?
gpl                 4  gnu (?:gpl|general public licen[cs]e)
gpl                 5  under (?:the )?gpl
gpl-1.0             2  spdx license identifier gpl 1 0
gpl-1.0             4  gnu general public license (?:as published by the free software foundation )?(?:either )?version 1
gpl-2.0             1  gnu general public license version 2 june 1991
gpl-2.0             2  spdx license identifier gpl 2 0
gpl-2.0             3  (?:www )?gnu org licenses (?:old licenses )?gpl 2 0
gpl-2.0             4  gnu general public license (?:as published by the free software foundation )?(?:either )?(?:version |v )2
gpl-2.0             4  (?:gnu )?gpl (?:version 2|v2|v 2|2 0)
gpl-2.0             4  gplv2
gpl-2.0-only        2  spdx license identifier gpl 2 0 only
gpl-2.0-only        4  gnu general public license (?:version 2|v2) only
gpl-2.0-or-later    1  either version 2 of the license or at your option any later version
gpl-2.0-or-later    2  spdx license identifier gpl 2 0 or later
gpl-2.0-or-later    4  (?:gnu )?gpl (?:version 2|v2|2) or (?:later|any later version)
gpl-2.0-classpath   1  linking this library statically or dynamically with other modules is making a combined work
gpl-2.0-classpath   4  gpl(?: 2 0)? with (?:the )?classpath exception
gpl-3.0             1  gnu general public license version 3 29 june 2007
gpl-3.0             1  the gnu general public license is a free copyleft license for software and other kinds of works
gpl-3.0             2  spdx license identifier gpl 3 0
gpl-3.0             3  (?:www )?gnu org licenses gpl 3 0
gpl-3.0             4  gnu general public license (?:as published by the free software foundation )?(?:either )?(?:version |v )3
gpl-3.0             4  (?:gnu )?gpl (?:version 3|v3|v 3|3 0)
gpl-3.0             4  gplv3
gpl-3.0-only        2  spdx license identifier gpl 3 0 only
gpl-3.0-only        4  gnu general public license (?:version 3|v3) only
gpl-3.0-or-later    1  either version 3 of the license or at your option any later version
gpl-3.0-or-later    2  spdx license identifier gpl 3 0 or later
gpl-3.0-or-later    4  (?:gnu )?gpl (?:version 3|v3|3) or (?:later|any later version)
lgpl                1  this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl                3  (?:www )?gnu org (?:licenses|copyleft) lgpl(?: html| txt)?
lgpl                4  gnu (?:lesser|library) general public licen[cs]e
lgpl                4  gnu lgpl
lgpl-2.0            1  gnu library general public license version 2 june 1991
lgpl-2.0            2  spdx license identifier lgpl 2 0
lgpl-2.1            1  gnu lesser general public license version 2 1 february 1999
lgpl-2.1            2  spdx license identifier lgpl 2 1
lgpl-2.1            4  gnu lesser general public license (?:as published by the free software foundation )?(?:either )?version 2 1
lgpl-2.1            4  (?:gnu )?lgpl (?:version 2 1|v2 1|2 1)
lgpl-2.1-or-later   1  either version 2 1 of the license or at your option any later version
lgpl-3.0            1  this version of the gnu lesser general public license incorporates the terms and conditions of version 3
lgpl-3.0            2  spdx license identifier lgpl 3 0
lgpl-3.0            4  gnu lesser general public license (?:as published by the free software foundation )?(?:either )?version 3
lgpl-3.0            4  (?:gnu )?lgpl (?:version 3|v3|3 0)
agpl                4  gnu affero general public licen[cs]e
agpl-3.0            1  gnu affero general public license version 3 19 november 2007
agpl-3.0            1  if you modify the program your modified version must prominently offer all users interacting with it remotely
agpl-3.0            2  spdx license identifier agpl 3 0
agpl-3.0            3  (?:www )?gnu org licenses agpl(?: 3 0)?
agpl-3.0            4  gnu affero general public license (?:as published by the free software foundation )?(?:either )?version 3
agpl-3.0            4  (?:gnu )?agpl (?:version 3|v3|3 0)
gfdl                1  permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl                4  gnu free documentation licen[cs]e
gfdl                3  (?:www )?gnu org (?:licenses|copyleft) fdl
mpl-1.0             4  mozilla public license (?:version |v )?1 0
mpl-1.1             1  the contents of this file are subject to the mozilla public license version 1 1
mpl-1.1             2  spdx license identifier mpl 1 1
mpl-1.1             4  mozilla public license (?:version |v )?1 1
mpl-2.0             1  this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0             1  if a copy of the mpl was not distributed with this file you can obtain one at
mpl-2.0             2  spdx license identifier mpl 2 0
mpl-2.0             3  (?:www )?mozilla org (?:en us )?mpl 2 0
mpl-2.0             4  mozilla public license (?:version |v )?2 0
mpl                 4  mozilla public licen[cs]e
epl-1.0             1  the accompanying program is provided under the terms of this eclipse public license
epl-1.0             2  spdx license identifier epl 1 0
epl-1.0             3  (?:www )?eclipse org legal epl v10
epl-1.0             4  eclipse public license (?:version |v )?1 0
epl-2.0             1  made available under the terms of the eclipse public license (?:v )?2 0
epl-2.0             2  spdx license identifier epl 2 0
epl-2.0             3  (?:www )?eclipse org legal epl (?:2 0|v20)
epl-2.0             4  eclipse public license (?:version |v )?2 0
epl                 4  eclipse public licen[cs]e
edl-1.0             4  eclipse distribution license
cpl-1.0             4  common public license(?: version)?(?: 1 0)?
ipl-1.0             4  ibm public license
cddl-1.0            1  the contents of this file are subject to the terms of the common development and distribution license
cddl-1.0            2  spdx license identifier cddl 1 0
cddl-1.0            4  common development and distribution license(?: version)?(?: 1 0)?
cddl-1.1            2  spdx license identifier cddl 1 1
cddl-1.1            4  common development and distribution license (?:version )?1 1
eupl-1.1            4  european union public licen[cs]e (?:version |v )?1 1
eupl-1.2            1  licensed under the eupl (?:version |v )?1 2
eupl-1.2            2  spdx license identifier eupl 1 2
eupl-1.2            4  european union public licen[cs]e(?: version| v)?(?: 1 2)?
artistic-1.0        1  the intent of this document is to state the conditions under which a package may be copied
artistic-1.0        2  spdx license identifier artistic 1 0
artistic-2.0        1  everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
artistic-2.0        2  spdx license identifier artistic 2 0
artistic-2.0        4  artistic license (?:version )?2 0
artistic            4  (?:perl )?artistic license
perl                4  under the same terms as perl itself
zlib                1  this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib                1  the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib                2  spdx license identifier zlib
zlib                4  zlib(?: libpng)? licen[cs]e
libpng              1  the png reference library is supplied as is
libpng              4  libpng license(?: version 2)?
bsl-1.0             1  obtaining a copy of the software and accompanying documentation covered by this license
bsl-1.0             2  spdx license identifier bsl 1 0
bsl-1.0             3  (?:www )?boost org license 1 0 txt
bsl-1.0             4  boost software licen[cs]e(?: version)?(?: 1 0)?
busl-1.1            1  the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use
busl-1.1            2  spdx license identifier busl 1 1
busl-1.1            4  business source licen[cs]e(?: version)?(?: 1 1)?
sspl-1.0            1  making the functionality of the program or modified version available to third parties as a service
sspl-1.0            2  spdx license identifier sspl 1 0
sspl-1.0            4  server side public licen[cs]e
elastic-2.0         1  you may not provide the software to third parties as a hosted or managed service
elastic-2.0         2  spdx license identifier elastic 2 0
elastic-2.0         4  elastic license(?: version)? 2 0
unlicense           1  this is free and unencumbered software released into the public domain
unlicense           2  spdx license identifier unlicense
unlicense           3  (?:www )?unlicense org
unlicense           4  the unlicense
wtfpl               1  everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed
wtfpl               2  spdx license identifier wtfpl
wtfpl               4  do what the fuck you want to public license
wtfpl               4  wtfpl (?:license|version 2)
cc0-1.0             1  the person who associated a work with this deed has dedicated the work to the public domain
cc0-1.0             2  spdx license identifier cc0 1 0
cc0-1.0             3  creativecommons org publicdomain zero 1 0
cc0-1.0             4  cc0 1 0(?: universal)?
cc0-1.0             4  creative commons (?:zero|cc0)
cc-pdm-1.0          3  creativecommons org publicdomain mark 1 0
cc-by               4  cc by(?! (?:sa|nc|nd))(?: [1-4] [05])?
cc-by               3  creativecommons org licenses by [1-4] [05]
cc-by               4  creative commons attribution(?! (?:sharealike|share|non|noncommercial|no|noderivatives|noderivs))(?: [1-4] [05])?(?: international| unported| generic)?
cc-by-2.0           2  spdx license identifier cc by 2 0
cc-by-3.0           2  spdx license identifier cc by 3 0
cc-by-4.0           2  spdx license identifier cc by 4 0
cc-by-4.0           1  by exercising the licensed rights you accept and agree to be bound by the terms and conditions of this creative commons attribution
cc-by-4.0           4  creative commons attribution 4 0(?: international)?
cc-by-sa            4  cc by sa(?: [1-4] [05])?
cc-by-sa            3  creativecommons org licenses by sa [1-4] [05]
cc-by-sa            4  creative commons attribution (?:sharealike|share alike)(?: [1-4] [05])?
cc-by-nc            4  cc by nc(?! (?:sa|nd))(?: [1-4])?(?: [05])?
cc-by-nc            3  creativecommons org licenses by nc [1-4] [05]
cc-by-nc            4  creative commons attribution (?:noncommercial|non commercial)(?! (?:sharealike|share|no|noderivatives|noderivs))(?: [1-4] [05])?
cc-by-nd            4  cc by nd(?: [1-4] [05])?
cc-by-nd            3  creativecommons org licenses by nd [1-4] [05]
cc-by-nd            4  creative commons attribution (?:noderivatives|noderivs|no derivatives)(?: [1-4] [05])?
cc-by-nc-sa         4  cc by nc sa(?: [1-4] [05])?
cc-by-nc-sa         3  creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc-sa         4  creative commons attribution (?:noncommercial|non commercial) (?:sharealike|share alike)(?: [1-4] [05])?
cc-by-nc-nd         4  cc by nc nd(?: [1-4] [05])?
cc-by-nc-nd         3  creativecommons org licenses by nc nd [1-4] [05]
cc-by-nc-nd         4  creative commons attribution (?:noncommercial|non commercial) (?:noderivatives|noderivs|no derivatives)(?: [1-4] [05])?
odbl-1.0            1  you are free to share to create and to adapt .{0,80}? as long as you attribute .{0,80}? share alike
odbl-1.0            3  opendatacommons org licenses odbl
odbl-1.0            4  open (?:data commons open )?database licen[cs]e
odc-by-1.0          3  opendatacommons org licenses by
odc-by-1.0          4  open data commons attribution licen[cs]e
pddl-1.0            4  public domain dedication and licen[cs]e
ofl-1.1             1  this font software is licensed under the sil open font license version 1 1
ofl-1.1             2  spdx license identifier ofl 1 1
ofl-1.1             3  scripts sil org ofl
ofl-1.1             4  sil open font licen[cs]e
psf-2.0             1  psf is making python available to licensee on an as is basis
psf-2.0             4  python software foundation licen[cs]e
ruby                4  ruby (?:s )?licen[cs]e
php-3.01            1  this product includes php software freely available from
php-3.01            4  php licen[cs]e(?: version)?(?: 3 01)?
postgresql          1  permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
postgresql          4  postgresql licen[cs]e
openssl             1  this product includes software developed by the openssl project for use in the openssl toolkit
openssl             4  openssl licen[cs]e
ncsa                4  (?:university of illinois )?ncsa open source license
upl-1.0             4  universal permissive licen[cs]e
ms-pl               4  microsoft public licen[cs]e
ms-rl               4  microsoft reciprocal licen[cs]e
cecill              4  (?:licence |cecill )cecill(?: 2 1)?
afl-3.0             1  licensed under the academic free license version 3 0
afl                 4  academic free licen[cs]e
osl-3.0             1  licensed under the open software license version 3 0
osl                 4  open software licen[cs]e
vim                 4  vim licen[cs]e
beerware            1  as long as you retain this notice you can do whatever you want with this stuff
beerware            4  (?:beerware|beer ware) license
unicode             1  obtaining a copy of the unicode data files and any associated documentation
unicode             4  unicode (?:inc )?license agreement
w3c                 4  w3c software (?:notice and|and document) license
json                1  the software shall be used for good not evil
llama               4  llama [2-4] community licen[cs]e
openrail            4  (?:creativeml |bigscience )?(?:openrail|open rail) (?:m )?licen[cs]e
polyform            4  polyform (?:noncommercial|small business|shield|strict) license
commons-clause      1  the grant of rights under the license will not include and the license does not grant to you the right to sell the software
commons-clause      4  commons clause (?:license|condition)
ogl-3.0             4  open government licen[cs]e(?: v3 0)?
etalab-2.0          4  (?:etalab |licence )ouverte(?: 2 0)?
dl-de-by-2.0        4  datenlizenz deutschland namensnennung(?: 2 0)?
public-domain       2  (?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain       4  this (?:work|file|text) is in the public domain
public-domain       5  no copyright is claimed
proprietary         1  this software is the confidential and proprietary information of
proprietary         1  unauthorized copying of this file via any medium is strictly prohibited
proprietary         2  no part of this (?:publication|work|book|document) may be reproduced
all-rights-reserved 5  all rights reserved
"""
#: How sure a rule of each priority is.
SURE = {1: 0.98, 2: 0.95, 3: 0.9, 4: 0.8, 5: 0.5}


def keyword(pattern: str) -> bytes:
    """The longest literal that every match holds. What a lookahead names is not in the match."""
    pattern = re.sub(r"\(\?!(?:[^()]|\([^()]*\))*\)", "\0", pattern)
    plain = re.sub(r"\([^()]*\)[?*]?|\(\?:[^()]*\)|\[[^]]*\]\??|\.\{[^}]*\}\??", "\0", pattern)
    return max(plain.split("\0"), key=len).strip().encode()


def rules() -> list[tuple]:
    """(rule id, label, priority, confidence, keyword, compiled pattern), best first."""
    raw = [(f"base:{b}", b, 4, 0.85, p) for p, b in BASE]
    for n, line in enumerate(RULES.strip().split("\n")):
        label, prio, pattern = line.split(maxsplit=2)
        raw.append((f"{n}:{label}", label, int(prio), SURE[int(prio)], pattern))
    return [(i, label, prio, sure, keyword(p), re.compile(rb"(?<![^ ])(?:" + p.encode() + rb")(?![^ ])")) for i, label, prio, sure, p in sorted(raw, key=lambda r: r[2])]


def gates(signatures: list[tuple]):
    """An automaton that finds, in one pass over a line, the rules whose keyword it holds."""
    by_key: dict[str, list[int]] = {}
    for n, (*_, key, _) in enumerate(signatures):
        by_key.setdefault(key.decode("latin-1"), []).append(n)
    found = ahocorasick.Automaton()
    for key, ns in by_key.items():
        found.add_word(key, tuple(ns))
    found.make_automaton()
    return found


WORD = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))


def line_of(text: str) -> bytes:
    """The words of a text, lower case, joined by one space."""
    return b" ".join(text.encode().lower().translate(WORD).split())


def detect(line: bytes, signatures: list[tuple], gate=None) -> list[tuple]:
    """(rule, label, priority, confidence, first word, end word, kept), by place."""
    gate = gate or gates(signatures)
    open_rules = sorted({n for _, ns in gate.iter(line.decode("latin-1")) for n in ns})
    found = [(m.start(), m.end(), prio, i, label, sure) for i, label, prio, sure, _, rx in map(signatures.__getitem__, open_rules) for m in rx.finditer(line)]
    found.sort(key=lambda d: (d[0], -d[1], d[2], d[3]))
    reach: dict[int, int] = {}  # by priority, how far the detections so far reach
    out, at, word = [], 0, 0
    for start, end, prio, i, label, sure in found:
        word += line.count(b" ", at, start)
        at = start
        inside = any(p <= prio and e >= end for p, e in reach.items())
        reach[prio] = max(reach.get(prio, 0), end)
        out.append((i, label, prio, sure, word, word + line.count(b" ", start, end) + 1, not inside))
    return out


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, detections) of every row; each detection says whether it was kept."""
    names = ("rule", "label", "priority", "confidence", "first_word", "end_word", "kept")

    def make():
        signatures = rules()
        gate = gates(signatures)

        def f(ids, texts):
            lines = [line_of(t) for t in texts]
            return ids, [x.count(b" ") + 1 if x else 0 for x in lines], [[dict(zip(names, d)) for d in detect(x, signatures, gate)] for x in lines]

        return f

    return map_rows(
        df,
        [F.col(id_col).cast("long"), text_of(text_col)],
        make,
        f"{id_col} long, n_words long, detections array<struct<rule: string, label: string, priority: int, confidence: double, first_word: long, end_word: long, kept: boolean>>",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("detections", lambda d: d["rule"].startswith("base:"))
    starts = F.transform(base, lambda d: d["first_word"])
    kept = F.filter("detections", lambda d: d["kept"] | d["rule"].startswith("base:"))
    names = lambda ds: F.array_join(F.array_sort(F.array_distinct(F.transform(ds, lambda d: d["label"]))), ",")
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"),
        names(kept).alias("labels"),
        F.coalesce(F.array_max(F.transform(kept, lambda d: d["confidence"])), F.lit(0.0)).alias("score"),
    )
