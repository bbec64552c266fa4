import re

from oracle import same
from pyspark.sql import functions as F

from orrery.llm import licenses

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of
this software and associated documentation files (the "Software"), to deal in the
Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the
following conditions:

The above copyright notice and this permission notice shall be included in all copies
or substantial portions of the Software."""
BSD = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
 * Redistributions of source code must retain the above copyright notice, this list
 * of conditions and the following disclaimer.
 * Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
 * following disclaimer in the documentation and/or other materials provided with the distribution."""
CASES = [
    (None, "", "", 0), ("", "", "", 0), ("No licence here, warranty void.", "", "", 0), ("words " * 5000, "", "", 0),
    ("Some text.\nReleased under the MIT License.", "MIT", "", 1),
    ("no stop at the end\nReleased under the MIT License.\nmore", "MIT", "", 1),
    ("Licensed under the Apache License, Version 2.0.", "Apache-2.0", "", 1),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0-only", "", 1),
    ("Licensed under CC BY-NC 4.0. Licensed under CC BY 4.0.", "CC-BY-4.0,CC-BY-NC-4.0", "", 2),
    (MIT, "MIT", "", 1), (f"// {MIT}".replace("\n", "\n//   "), "MIT", "", 1), (BSD, "BSD-2-Clause", "", 1),
    (BSD + "\nNeither the name of the Acme Corp nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "BSD-3-Clause", "", 1),
    ("You may not use this file except in compliance with the License.", "", "apache-comply", 0),
    ("It is not so that it is released under the MIT License.", "", "", 0),
]


def test_cases(spark):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, (t, *_) in enumerate(CASES)] + [(4, CASES[4][0], "x", "y")], "doc_id long, text string, licenses string, `a.b` string")
    found = licenses.scan_licenses(docs).collect()
    assert len(found) == len(CASES) + 1 and found[0]["a.b"] == "y"
    for r in found:
        assert (r.licenses, r.unmatched, r.n_licenses) == CASES[r.doc_id][1:], CASES[r.doc_id][0]
    assert licenses.scan_licenses(docs.limit(0)).collect() == []


def test_every_rule_has_known_sentences():
    assert {s for _, rule in licenses.RULES for s in rule.split()} <= set(licenses.SENTENCES)


def test_the_joined_pattern_changes_nothing(spark):
    """sentence_id looks for one of the sentences only where the joined pattern matches; on these texts, with and without words around, it must not matter."""
    import random

    rng = random.Random(2)
    parts = [w for t in licenses.SENTENCES.values() for w in re.sub(r"[\\\[\]^{}?|()]", " ", t).split()] + ["\n", "spdx-license-identifier:", "x"]
    texts = [" ".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(300)]
    texts += [re.sub(r"\(\?:([^()|]*)[^()]*\)\??", r"\1", t) for t in licenses.SENTENCES.values()]
    whole = lambda s: next((n for n in licenses.SENTENCES if re.search(licenses._pattern(n).replace("$", r"\Z"), s)), None)
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", licenses.sentence_id(F.col("t")).alias("id")).collect()
    assert [(r.t, r.id, whole(r.t)) for r in found if r.id != whole(r.t)] == []


WITHOUT_A_HINT = [
    ("Released under CC BY 4.0.", "CC-BY-4.0"), ("This article is released under CC BY-SA 4.0.", "CC-BY-SA-4.0"), ("Dedicated to the CC0 1.0 Universal.", "CC0-1.0"), ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "LGPL-2.1-or-later"),
    ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", "Zlib"),
]


def test_sentences_of_any_words_are_found(spark):
    docs = spark.createDataFrame([(f"Some words. {t}" + " more words" * 9000 * k, x) for t, x in WITHOUT_A_HINT for k in (0, 1)], "text string, want string")
    assert [(r.want, r.licenses) for r in licenses.scan_licenses(docs).collect() if r.licenses != r.want] == []


def test_sql(spark, sf_dir):
    same(spark, licenses.op9_license_scan, licenses.OP9_SQL, sf_dir)


GPL = """/* This program is free software{} you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation{} either version {} of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
 */"""
MPL = """# This Source Code Form is subject to the terms of the Mozilla Public
# License, v. 2.0. If a copy of the MPL was not distributed with this
# file, You can obtain one at https://mozilla.org/MPL/2.0/."""
NOTICES = [
    (GPL.format(";", ";", 2), "GPL-2.0-or-later", ""), (GPL.format(":", ",", 3), "GPL-3.0-or-later", ""), (MPL, "MPL-2.0", ""), (MPL.split(" If")[0], "MPL-2.0", ""),
    ("// SPDX-License-Identifier: MIT\nint main() {}", "MIT", ""), ("<!-- SPDX-License-Identifier: GPL-2.0+ -->", "GPL-2.0-or-later", ""), ("x\n# SPDX-License-Identifier: Apache-2.0.", "Apache-2.0", ""),
    ("/* SPDX-License-Identifier: (GPL-2.0 WITH Linux-syscall-note) OR MIT */", "GPL-2.0-only,MIT", ""), ("SPDX-License-Identifier: (MIT OR Apache-2.0) AND (Zlib OR ISC)\nthen", "Apache-2.0,ISC,MIT,Zlib", ""),
    ("SPDX-License-Identifier: MIT OR ISC OR Zlib OR X11 OR W3C OR Vim OR HPND", "HPND,ISC,MIT,Vim,W3C,X11,Zlib", ""), ("SPDX-License-Identifier: LicenseRef-Own", "", "spdx-tag"),
]


def test_notices_that_hold_a_cut(spark):
    for r in licenses.scan_licenses(spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(NOTICES)], "i int, text string")).collect():
        assert (r.licenses, r.unmatched) == NOTICES[r.i][1:], r


def test_every_sentence_is_found_by_its_own_text(spark):
    pick = lambda t: re.sub(r"\[\^\.\]\{1,80\}", "acme", re.sub(r"\[a-z0-9\.\+-\]\+", "licenseref-x", t))

    def sample(name):
        text = pick(licenses.SENTENCES[name])
        if not re.search(r"\(\?|\\|\[", licenses.SENTENCES[name]):
            return text
        text = text.replace("\\(", "<").replace("\\)", ">")
        while (new := re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)\??", r"\1", text)) != text:
            text = new
        text = text.replace("<", "(").replace(">", ")")
        return re.sub(r"\\(.)", r"\1", text.replace("https?", "https").replace("[.;]", ".").replace("\\.?", "."))

    docs = spark.createDataFrame([(n, f"Some words before.\n\n{sample(n)} Some words after.") for n in licenses.SENTENCES], "name string, text string")
    found = docs.select("name", "text", F.array_compact(F.transform(licenses.sentences(F.col("text")), licenses.sentence_id)).alias("ids")).collect()
    assert [(r.name, r.ids, r.text) for r in found if r.ids != [r.name]] == []


def test_a_tag_of_any_number_of_licenses_and_the_sql(spark, tmp_path):
    known = [x for x in licenses._SPDX if re.fullmatch(r"[a-z0-9.+-]+", x)][:20]
    want = ",".join(sorted({licenses._SPDX[x] for x in known}))
    texts = [
        "SPDX-License-Identifier: " + " OR ".join(known), "x\n# SPDX-License-Identifier: (" + ") AND (".join(known) + ")\nint main() and more. SPDX-License-Identifier: MIT or not, and then",
        "SPDX-License-Identifier: MIT OR Apache-2.0 OR ISC OR Zlib OR 0BSD OR BSL-1.0 OR Unlicense", "spdx-license-identifier: ??? and MIT", "SPDX-License-Identifier : \"GPL-2.0 WITH Classpath-exception-2.0\" OR (MIT)",
        "SPDX-License-Identifier: " + " OR ".join(["mit"] * 3000), "spdx-license-identifierspdx-license-identifier:mit and", "",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in licenses.op9_license_scan(spark, str(tmp_path)).collect()}
    assert len(known) == 20 and (found[0].licenses, found[0].unmatched) == (want, "")
    assert set(want.split(",")) <= set(found[1].licenses.split(","))
    assert (found[2].licenses, found[2].unmatched) == ("0BSD,Apache-2.0,BSL-1.0,ISC,MIT,Unlicense,Zlib", "")
    assert found[5].licenses == "MIT"
    import duckdb
    from oracle import rows_of

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(licenses.OP9_SQL)
    assert rows_of(list(found[0].asDict()), [tuple(r) for r in found.values()]) == rows_of(want.columns, want.fetchall())
