"""License scans by sentence rules, in DataFrame functions alone."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.frames import documents, named

# Known sentences, lower-cased, white space and quotation marks unified, by identifier. <v> is a version, <x> any run of words.
SENTENCES = {
    "mit-grant": 'permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "software"), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions:',
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software.",
    "mit-as-is": 'the software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.',
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
    "mit-name": "(?:this (?:work|software|project|file) is )?(?:released|licensed|distributed|available) under the (?:terms of the )?mit license.",
    "apache-name": "(?:this (?:work|software|project|file) is )?(?:released|licensed|distributed) under the apache license, version 2\\.0(?: \\(the \"license\"\\))?[.;]",
    "apache-comply": "you may not use this file except in compliance with the license.",
    "apache-copy": "you may obtain a copy of the license at(?: https?://www\\.apache\\.org/licenses/license-2\\.0)?(?::|)",
    "apache-as-is": 'unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an "as is" basis, without warranties or conditions of any kind, either express or implied.',
    "apache-specific": "see the license for the specific language governing permissions and limitations under the license.",
    "gpl3-name": "(?:this (?:work|software|project|file) is )?(?:released|licensed|distributed) under the (?:terms of the )?gnu general public license, version 3(?:\\.0)?\\.",
    "gpl2-name": "(?:this (?:work|software|project|file) is )?(?:released|licensed|distributed) under the (?:terms of the )?gnu general public license, version 2(?:\\.0)?\\.",
    "gpl2-later": "this program is free software; you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation; either version 2 of the license, or \\(at your option\\) any later version.",
    "gpl3-later": "this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version 3 of the license, or \\(at your option\\) any later version.",
    "gpl-hope": "this program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose.",
    "gpl-details": "see the gnu general public license for more details.",
    "gpl-received": "you should have received a copy of the gnu general public license along with this program.",
    "lgpl21-name": "(?:this (?:work|software|library) is )?(?:released|licensed|distributed) under the (?:terms of the )?gnu lesser general public license, version 2\\.1\\.",
    "lgpl3-name": "(?:this (?:work|software|library) is )?(?:released|licensed|distributed) under the (?:terms of the )?gnu lesser general public license, version 3(?:\\.0)?\\.",
    "agpl3-name": "(?:this (?:work|software|program) is )?(?:released|licensed|distributed) under the (?:terms of the )?gnu affero general public license, version 3(?:\\.0)?\\.",
    "bsd-grant": "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "(?:1\\. )?redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "(?:2\\. )?redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "(?:3\\. )?neither the name of (?:the )?[^.]{1,80} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-as-is": '(?:this software is provided by the copyright holders and contributors|this software is provided by the [^.]{1,80}) "as is" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.',
    "isc-grant": "permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-as-is": 'the software is provided "as is" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness.',
    "mpl2-name": "this source code form is subject to the terms of the mozilla public license, v\\. 2\\.0.",
    "mpl2-copy": "if a copy of the mpl was not distributed with this file, you can obtain one at https?://mozilla\\.org/mpl/2\\.0/\\.?",
    "unlicense": "this is free and unencumbered software released into the public domain.",
    "cc-by": "(?:this (?:work|article|page) is )?(?:released|licensed|distributed) under (?:a |the )?(?:cc by|creative commons attribution)(?: (?:international )?(?:license )?)?4\\.0(?: international)?(?: license)?\\.",
    "cc-by-sa": "(?:this (?:work|article|page) is )?(?:released|licensed|distributed) under (?:a |the )?(?:cc by-sa|creative commons attribution-sharealike) 4\\.0(?: international)?(?: license)?\\.",
    "cc-by-nc": "(?:this (?:work|article|page) is )?(?:released|licensed|distributed) under (?:a |the )?(?:cc by-nc|creative commons attribution-noncommercial) 4\\.0(?: international)?(?: license)?\\.",
    "cc-by-nc-sa": "(?:this (?:work|article|page) is )?(?:released|licensed|distributed) under (?:a |the )?(?:cc by-nc-sa|creative commons attribution-noncommercial-sharealike) 4\\.0(?: international)?(?: license)?\\.",
    "cc-by-nd": "(?:this (?:work|article|page) is )?(?:released|licensed|distributed) under (?:a |the )?(?:cc by-nd|creative commons attribution-noderivatives) 4\\.0(?: international)?(?: license)?\\.",
    "cc0": "(?:this (?:work|article|page) is )?(?:released|licensed|dedicated) (?:under|to) (?:a |the )?(?:cc0|creative commons zero)(?: 1\\.0)?(?: universal)?(?: license)?\\.",
    "spdx-tag": "spdx-license-identifier: [a-z0-9.+-]+",
    "all-rights": "all rights reserved.",
    "lgpl21-later": "this library is free software; you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation; either version 2\\.1 of the license, or \\(at your option\\) any later version.",
    "lgpl3-later": "this (?:library|program) is free software: you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation, either version 3 of the license, or \\(at your option\\) any later version.",
    "lgpl-hope": "this library is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose.",
    "lgpl-details": "see the gnu lesser general public license for more details.",
    "lgpl-received": "you should have received a copy of the gnu lesser general public license along with this (?:library|program).",
    "agpl3-later": "this program is free software: you can redistribute it and/or modify it under the terms of the gnu affero general public license as published by the free software foundation, either version 3 of the license, or \\(at your option\\) any later version.",
    "agpl-details": "see the gnu affero general public license for more details.",
    "agpl-received": "you should have received a copy of the gnu affero general public license along with this program.",
    "gpl2-only": "this program is free software; you can redistribute it and/or modify it under the terms of the gnu general public license(?: version 2)? as published by the free software foundation[.;]",
    "bsd4-advertise": "(?:3\\. )?all advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd-liability": "in no event shall the (?:copyright owner or contributors|copyright holder or contributors|copyright holders or contributors|authors or contributors) be liable for any direct, indirect, incidental, special, exemplary, or consequential damages \\(including, but not limited to, procurement of substitute goods or services;",
    "isc-liability": "in no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software.",
    "0bsd-grant": "permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted.",
    "mit0-grant": 'permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "software"), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so.',
    "zlib-as-is": "this software is provided 'as-is', without any express or implied warranty.",
    "zlib-liability": "in no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "bsl-name": "(?:this (?:work|software|project|file) is )?(?:released|licensed|distributed) under the boost software license, version 1\\.0.",
    "epl2-name": "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2\\.0 which (?:accompanies this distribution|is available at https?://www\\.eclipse\\.org/legal/epl-2\\.0/)\\.?",
    "bsd-name": "(?:this (?:work|software|project|file) is )?(?:released|licensed|distributed|available) under the (?:terms of the )?(?:new |modified |3-clause )bsd license.",
    "bsd2-name": "(?:this (?:work|software|project|file) is )?(?:released|licensed|distributed|available) under the (?:terms of the )?(?:simplified |2-clause )bsd license.",
    "isc-name": "(?:this (?:work|software|project|file) is )?(?:released|licensed|distributed|available) under the (?:terms of the )?isc license.",
    "mpl-name": "(?:this (?:work|software|project|file) is )?(?:released|licensed|distributed|available) under the (?:terms of the )?mozilla public (?:license|license,) version 2\\.0.",
    "unlicense-use": "anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "cc-by-nc-nd": "(?:this (?:work|article|page) is )?(?:released|licensed|distributed) under (?:a |the )?(?:cc by-nc-nd|creative commons attribution-noncommercial-noderivatives) 4\\.0(?: international)?(?: license)?\\.",
    "wtfpl": "(?:0\\. )?you just do what the fuck you want to.",
}

# SPDX identifiers that tags name; old forms by the identifier that replaces them. Other tags are spdx-tag, which no rule takes.
_SPDX = {
    x.lower(): x
    for x in """0BSD AFL-3.0 AGPL-1.0-only AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 APSL-2.0 Artistic-1.0 Artistic-2.0 BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause
    BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BUSL-1.1 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0
    CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CPL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.3-only GFDL-1.3-or-later GPL-1.0-only GPL-1.0-or-later
    GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later HPND ISC LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later
    libpng-2.0 LPPL-1.3c MIT MIT-0 MPL-1.1 MPL-2.0 MPL-2.0-no-copyleft-exception MS-PL MS-RL MulanPSL-2.0 NCSA ODbL-1.0 OFL-1.1 OSL-3.0 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0
    Unicode-3.0 Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1""".split()
} | {f"{n}{old}": f"{n}{new}".upper().replace("ONLY", "only").replace("OR-LATER", "or-later") for n in ("gpl-1.0", "gpl-2.0", "gpl-3.0", "lgpl-2.0", "lgpl-2.1", "lgpl-3.0", "agpl-3.0") for old, new in (("", "-only"), ("+", "-or-later"))}
SENTENCES = {f"spdx-{x}": f"spdx-license-identifier: {x}" for x in _SPDX} | SENTENCES

# Ordered rules, each a sequence of sentences that stand for one license. Earlier rules take their sentences first.
RULES = [
    ("BSD-4-Clause", "bsd-grant bsd-source bsd-binary bsd4-advertise bsd-endorse bsd-as-is bsd-liability"),
    ("BSD-4-Clause", "bsd-grant bsd-source bsd-binary bsd4-advertise"),
    ("BSD-3-Clause", "bsd-grant bsd-source bsd-binary bsd-endorse bsd-as-is bsd-liability"),
    ("BSD-3-Clause", "bsd-grant bsd-source bsd-binary bsd-endorse"),
    ("BSD-2-Clause", "bsd-grant bsd-source bsd-binary bsd-as-is bsd-liability"),
    ("BSD-2-Clause", "bsd-grant bsd-source bsd-binary"),
    ("LGPL-2.1-or-later", "lgpl21-later lgpl-hope lgpl-details lgpl-received"),
    ("LGPL-2.1-or-later", "lgpl21-later lgpl-hope lgpl-details"),
    ("LGPL-2.1-or-later", "lgpl21-later"),
    ("LGPL-3.0-or-later", "lgpl3-later lgpl-hope lgpl-details lgpl-received"),
    ("LGPL-3.0-or-later", "lgpl3-later gpl-hope lgpl-details lgpl-received"),
    ("LGPL-3.0-or-later", "lgpl3-later"),
    ("AGPL-3.0-or-later", "agpl3-later gpl-hope agpl-details agpl-received"),
    ("AGPL-3.0-or-later", "agpl3-later gpl-hope agpl-details"),
    ("AGPL-3.0-or-later", "agpl3-later"),
    ("GPL-2.0-or-later", "gpl2-later gpl-hope gpl-details gpl-received"),
    ("GPL-3.0-or-later", "gpl3-later gpl-hope gpl-details gpl-received"),
    ("GPL-2.0-only", "gpl2-only gpl-hope gpl-details gpl-received"),
    ("GPL-2.0-only", "gpl2-only gpl-hope gpl-details"),
    ("GPL-2.0-only", "gpl2-only"),
    ("GPL-2.0-or-later", "gpl2-later gpl-hope gpl-details"),
    ("GPL-2.0-or-later", "gpl2-later"),
    ("GPL-3.0-or-later", "gpl3-later gpl-hope gpl-details"),
    ("GPL-3.0-or-later", "gpl3-later"),
    ("MIT", "mit-grant mit-notice mit-as-is mit-liability"),
    ("MIT", "mit-grant mit-notice"),
    ("MIT-0", "mit0-grant mit-as-is mit-liability"),
    ("MIT-0", "mit0-grant"),
    ("ISC", "isc-grant isc-as-is isc-liability"),
    ("ISC", "isc-grant isc-as-is"),
    ("0BSD", "0bsd-grant isc-as-is isc-liability"),
    ("0BSD", "0bsd-grant"),
    ("Zlib", "zlib-as-is zlib-liability zlib-grant"),
    ("Zlib", "zlib-grant"),
    ("BSL-1.0", "bsl-name"),
    ("EPL-2.0", "epl2-name"),
    ("BSD-3-Clause", "bsd-name"),
    ("BSD-2-Clause", "bsd2-name"),
    ("ISC", "isc-name"),
    ("MPL-2.0", "mpl-name"),
    ("Unlicense", "unlicense unlicense-use"),
    ("WTFPL", "wtfpl"),
    ("CC-BY-NC-ND-4.0", "cc-by-nc-nd"),
    ("ISC", "isc-grant"),
    ("Apache-2.0", "apache-name apache-comply apache-copy apache-as-is apache-specific"),
    ("Apache-2.0", "apache-name apache-comply"),
    ("Apache-2.0", "apache-name"),
    ("MPL-2.0", "mpl2-name mpl2-copy"),
    ("MPL-2.0", "mpl2-name"),
    ("MIT", "mit-name"),
    ("GPL-3.0-only", "gpl3-name"),
    ("GPL-2.0-only", "gpl2-name"),
    ("LGPL-2.1-only", "lgpl21-name"),
    ("LGPL-3.0-only", "lgpl3-name"),
    ("AGPL-3.0-only", "agpl3-name"),
    ("Unlicense", "unlicense"),
    ("CC-BY-4.0", "cc-by"),
    ("CC-BY-SA-4.0", "cc-by-sa"),
    ("CC-BY-NC-4.0", "cc-by-nc"),
    ("CC-BY-NC-SA-4.0", "cc-by-nc-sa"),
    ("CC-BY-ND-4.0", "cc-by-nd"),
    ("CC0-1.0", "cc0"),
    *((license, f"spdx-{x}") for x, license in _SPDX.items()),
]

_PLAIN = str.maketrans({"(": r"\(", ")": r"\)", "+": r"\+", "*": r"\*", ".": r"\."})
_TAG = "spdx-license-identifier:"
#: How a tag's expression begins, how each further part does, what a part may name, and a part that another one can follow.
_TAG_BEGINS, _PART_BEGINS = _TAG[:-1] + " ?:[ \x02]?", " (?:and|or) "
_NAMED = "[(\"']*([a-z0-9.+-]*[a-z0-9+])"
_WHOLE = rf"(?:{_TAG_BEGINS}|{_PART_BEGINS}){_NAMED}(?: with [a-z0-9.+-]+)?\)*\z"
#: What normalising replaces, in order. \x02 is a blank inside a known sentence, where no sentence ends.
_NORMAL = [
    ("[“”]|``|''", '"'),
    (r"(^|\n)[ \t]*(?:/\*+|\*+/?|#+|//+|--|;+|rem )[ \t]*", "{1}"),
    (r"[ \t\r\f\x0B]{2,}|[\t\r\f\x0B]", " "),
    (r" ?\n ?", "\n"),
    (r"\n\n+", "\x01"),
    (r"free[ \n]software([;:])[ \n]you[ \n]can[ \n]redistribute", "free software{1}\x02you can redistribute"),
    (r"free[ \n]software[ \n]foundation;[ \n]either[ \n]version", "free software foundation;\x02either version"),
    (r"without[ \n]any[ \n]warranty;[ \n]without[ \n]even", "without any warranty;\x02without even"),
    (r"(public[ \n]license,?)[ \n]v\.[ \n]2\.0", "{1} v.\x022.0"),
]
_ENDS = [(r"([.!?:;])[ \n]", "{1}\x01"), ("\x02", " ")]


def _body(name: str) -> str:
    text = SENTENCES[name]
    text = text if re.search(r"\(\?|\\|\[", text) else text.translate(_PLAIN)
    return text.replace(" ", r"[ \n]")


def _pattern(name: str) -> str:
    """A known sentence at the beginning of a sentence or of one of its lines, up to the sentence's end."""
    return rf"(?:^|\n)(?:{_body(name)})$"


def sentences(text: Column) -> Column:
    """array<string>: a text's sentences, normalised.

    Lower case, straight quotation marks, comment signs at the beginnings of lines and runs of blanks gone; a sentence ends after
    . ! ? : or ; before white space, or where the text changes paragraph. Other line breaks stay as such. Known sentences that hold such a
    cut stay whole, and each license of an SPDX tag, of however many, is a sentence.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    replaced = low
    for pattern, to in _NORMAL:
        replaced = F.regexp_replace(replaced, pattern, to.format(None, "$1"))

    def ended(text: Column, rules: list[tuple[str, str]]) -> Column:
        for pattern, to in rules:
            text = F.regexp_replace(text, pattern, to.format(None, "$1"))
        return F.transform(F.split(text, "\x01"), lambda s: F.trim(s))

    return once(replaced, lambda x: ended(F.when(F.contains(x, F.lit(_TAG[:-1])), _tags_cut(x)).otherwise(x), _ENDS))


def _tags_cut(text: Column) -> Column:
    """text with each license that an SPDX tag names as a tag of its own, between marks.

    A tag's expression goes on over `and` and `or` as long as the part before is a name alone, parentheses and exceptions aside.
    """
    begin = f"^(?:{_TAG_BEGINS}|{_PART_BEGINS}){_NAMED}"

    def cut(tokens: Column, k: Column) -> Column:
        names = F.filter(F.transform(F.slice(tokens, 1, k), lambda t: F.regexp_extract(t, begin, 1)), lambda x: x != "")
        rest = F.concat(F.regexp_replace(F.element_at(tokens, k), begin, ""), F.array_join(F.slice(tokens, k + 1, F.size(tokens)), ""))
        return F.concat(F.array_join(F.transform(names, lambda x: F.concat(F.lit(f"\x01{_TAG}\x02"), x, F.lit("\x01"))), ""), rest)

    def one(part: Column) -> Column:
        def ended(tokens: Column) -> Column:
            first = F.array_position(F.transform(tokens, lambda t: t.rlike("^" + _WHOLE)), F.lit(False))
            return once(F.when(first == 0, F.size(tokens)).otherwise(first).cast("int"), lambda k: cut(tokens, k))

        return F.when(part.rlike(f"^{_TAG_BEGINS}{_NAMED}"), once(F.split(part, f"(?={_PART_BEGINS})"), ended)).otherwise(part)

    return F.array_join(F.transform(F.split(text, f"(?={_TAG[:-1]})"), one), "")


def once(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Matches what any known sentence matches: their patterns, joined.
_ANY_SENTENCE = "(?:^|\\n)(?:" + "|".join(_body(name) for name in SENTENCES if not name.startswith("spdx-") or name == "spdx-tag") + ")$"


def sentence_id(sentence: Column) -> Column:
    """The known sentence's identifier, or null."""
    found = F
    for name in SENTENCES:
        found = found.when(sentence.rlike(_pattern(name)), F.lit(name))
    return F.when(sentence.rlike(_ANY_SENTENCE), found)


def _rules(ids: Column) -> Column:
    """The identifiers, each between spaces and marks, with rule matches replaced in order by =license."""
    seq = F.concat(F.lit(" "), F.array_join(ids, "  "), F.lit(" "))
    for license, rule in RULES:
        seq = F.replace(seq, F.lit(" " + rule.replace(" ", "  ") + " "), F.lit(f" ={license} "))
    return F.filter(F.split(seq, " +"), lambda x: x != "")


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with sentence_ids, licenses, unmatched (strings, comma-joined) and n_licenses (long) appended.

    sentence_ids: known license sentences in the text's order. Ordered rules replace sequences of them by licenses: those
    found are `licenses`, sorted and distinct; sentences that no rule takes are `unmatched`, in order. Null and empty texts and
    texts without known sentences have empty strings and 0. Every text is cut to sentences whole, whatever its length. A rule's sentences
    follow one another in the order of known sentences: other text may stand between, as copyright lines and clauses do. Row by row, no
    shuffle; repeated rows get the same result, an empty table gives no rows, extra columns pass through, and columns named as the results are replaced.
    """
    text = named(text_col)
    ids = F.filter(F.transform(sentences(text), sentence_id), lambda x: x.isNotNull())
    out = docs.withColumn("sentence_ids", ids)
    out = out.withColumn("unmatched", F.when(F.size("sentence_ids") > 0, _rules(F.col("sentence_ids"))).otherwise(F.array().cast("array<string>")))
    licenses = F.array_sort(F.array_distinct(F.transform(F.filter("unmatched", lambda x: x.startswith("=")), lambda x: F.substr(x, F.lit(2)))))
    return (
        out.withColumn("licenses", F.array_join(licenses, ","))
        .withColumn("n_licenses", F.size(licenses).cast("long"))
        .withColumn("unmatched", F.array_join(F.filter("unmatched", lambda x: ~x.startswith("=")), ","))
        .withColumn("sentence_ids", F.array_join("sentence_ids", ","))
    )


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def _sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    low = "lower(coalesce(text, ''))"

    def replaced(text: str, rules: list[tuple[str, str]]) -> str:
        for pattern, to in rules:
            text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(to.format(None, chr(92) + '1'))}, 'g')"
        return text

    begin = quoted(f"^(?:{_TAG_BEGINS}|{_PART_BEGINS}){_NAMED}")
    low = replaced(low, _NORMAL)
    ids = " ".join(f"WHEN regexp_matches(s, {quoted(_pattern(name))}) THEN {quoted(name)}" for name in SENTENCES)
    seq = "' ' || array_to_string(ids, '  ') || ' '"
    for license, rule in RULES:
        seq = f"replace({seq}, {quoted(' ' + rule.replace(' ', '  ') + ' ')}, {quoted(f' ={license} ')})"
    return rf"""
WITH normal AS (SELECT doc_id, {low} AS text FROM documents),
parts AS (SELECT doc_id, unnest(p) AS part, generate_subscripts(p, 1) AS n FROM (SELECT doc_id, string_split(replace(text, {quoted(_TAG[:-1])}, chr(3) || {quoted(_TAG[:-1])}), chr(3)) AS p FROM normal)),
tokens AS (SELECT doc_id, n, part, CASE WHEN regexp_matches(part, {quoted(f'^{_TAG_BEGINS}{_NAMED}')}) THEN string_split(regexp_replace(part, ' (and|or) ', chr(3) || ' \1 ', 'g'), chr(3)) END AS t FROM parts),
ends AS (SELECT *, coalesce(nullif(list_position(list_transform(t, lambda x: regexp_matches(x, {quoted('^' + _WHOLE)})), FALSE), 0), len(t)) AS k FROM tokens),
tagged AS (SELECT doc_id, string_agg(CASE WHEN t IS NULL THEN part ELSE array_to_string(list_transform(list_filter(list_transform(t[1:k], lambda x: regexp_extract(x, {begin}, 1)), lambda x: x <> ''), lambda x: chr(1) || {quoted(_TAG + chr(2))} || x || chr(1)), '')
  || regexp_replace(t[k], {begin}, '') || array_to_string(t[k + 1:], '') END, '' ORDER BY n) AS text FROM ends GROUP BY doc_id),
cuts AS (SELECT doc_id, string_split({replaced('text', _ENDS)}, chr(1)) AS c FROM tagged),
sentences AS (SELECT DISTINCT unnest(list_transform(c, lambda s: trim(s))) AS s, doc_id, generate_subscripts(c, 1) AS pos FROM cuts),
known AS (SELECT s, CASE {ids} END AS id FROM (SELECT DISTINCT s FROM sentences)),
cut AS (SELECT doc_id, list(id ORDER BY pos) AS ids FROM sentences JOIN known USING (s) WHERE id IS NOT NULL GROUP BY doc_id),
every AS (SELECT d.doc_id, coalesce(ids, []) AS ids FROM documents d LEFT JOIN cut USING (doc_id)),
ruled AS (SELECT doc_id, ids, list_filter(string_split_regex({seq}, ' +'), lambda x: x <> '') AS parts FROM every),
found AS (SELECT *, list_sort(list_distinct(list_transform(list_filter(parts, lambda x: starts_with(x, '=')), lambda x: substr(x, 2)))) AS licenses FROM ruled)
SELECT doc_id, array_to_string(ids, ',') AS sentence_ids, array_to_string(list_filter(parts, lambda x: NOT starts_with(x, '=')), ',') AS unmatched,
       array_to_string(licenses, ',') AS licenses, CAST(len(licenses) AS BIGINT) AS n_licenses
FROM found
"""


OP9_SQL = _sql()
