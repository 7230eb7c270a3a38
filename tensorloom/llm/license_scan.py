"""Licence scans by sentence rules: known sentences get identifiers, and ordered rules match runs of identifiers.

A text is normalised to lower-case letters and digits with single blanks. Sentences end at blank lines; line ends and
. ! ? : ; with white space may end one or stand inside, so that wrapped texts are known, too. Known sentences become identifiers, others a dash, and the rules are tried in
order on the sequence: what a rule matches is taken out before the next one is tried, so longer texts come first.
Everything is row-wise expressions; the tables of sentences and rules are small constants.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

# Sentences of public licence texts and notices, normalised, and what they are called here.
SENTENCES: dict[str, str] = {
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "mit license": "mit-title",
    "the mit license": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-condition",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "licensed under the apache license version 2 0": "apache-notice",
    "licensed under the apache license version 2 0 the license": "apache-notice",
    "you may not use this file except in compliance with the license": "apache-compliance",
    "you may obtain a copy of the license at": "apache-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-warranty",
    "apache license version 2 0": "apache-title",
    "this work is licensed under the gnu general public license version 3": "gpl3-notice",
    "licensed under the gnu general public license version 3": "gpl3-notice",
    "gnu general public license version 3": "gpl3-title",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-grant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "licensed under cc by nc 4 0": "cc-by-nc-notice",
    "licensed under cc by 4 0": "cc-by-notice",
    "licensed under cc by sa 4 0": "cc-by-sa-notice",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-notice",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc-notice",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-notice",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-warranty",
    "bsd 2 clause license": "bsd2-title",
    "bsd 3 clause license": "bsd3-title",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-warranty",
    "isc license": "isc-title",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd-grant",
    "gnu general public license version 2": "gpl2-title",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3-grant",
    "gnu affero general public license version 3": "agpl3-title",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21-grant",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-grant",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "gnu lesser general public license version 2 1": "lgpl21-title",
    "gnu lesser general public license version 3": "lgpl3-title",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-notice",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl-copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl-copy",
    "mozilla public license version 2 0": "mpl-title",
    "this is free and unencumbered software released into the public domain": "unlicense-notice",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-grant",
    "the unlicense": "unlicense-title",
    "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work": "cc0-waiver",
    "cc0 1 0 universal": "cc0-title",
    "this software is provided as is without any express or implied warranty": "zlib-warranty",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "distributed under the boost software license version 1 0": "bsl-notice",
    "boost software license version 1 0": "bsl-title",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0": "epl2-notice",
    "eclipse public license v 2 0": "epl2-title",
    "the artistic license 2 0": "artistic2-title",
    "this work is licensed under a creative commons attribution noderivatives 4 0 international license": "cc-by-nd-notice",
    "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license": "cc-by-nc-sa-notice",
    "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license": "cc-by-nc-nd-notice",
    "all rights reserved": "reserved",
}
# Identifiers of licences as they stand in tags.
TAGS = (
    "0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-3-Clause-Clear BSL-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 "
    "CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.2 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only "
    "LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA OFL-1.1 OSL-3.0 PostgreSQL Python-2.0 Unlicense UPL-1.0 W3C Zlib"
).split()
#: How a tag's sentence begins; each tag is a known sentence whose identifier is its name's words.
TAG_HEAD = "spdx license identifier"
TAG_WORDS = {tag: re.sub("[^a-z0-9]+", " ", tag.lower()) for tag in TAGS}
KNOWN = SENTENCES | {f"{TAG_HEAD} {w}": f"tag {w}" for w in TAG_WORDS.values()}
#: (licence, identifiers in a row), tried in this order.
RULES: list[tuple[str, list[str]]] = [
    ("MIT", ["mit-title", "mit-grant", "mit-condition", "mit-warranty"]),
    ("MIT", ["mit-grant", "mit-condition", "mit-warranty"]),
    ("Apache-2.0", ["apache-notice", "apache-compliance", "apache-copy"]),
    ("Apache-2.0", ["apache-notice", "apache-compliance"]),
    ("GPL-3.0-or-later", ["gpl3-grant", "gpl-warranty"]),
    ("AGPL-3.0-or-later", ["agpl3-grant", "gpl-warranty"]),
    ("GPL-2.0-or-later", ["gpl2-grant", "gpl-warranty"]),
    ("LGPL-2.1-or-later", ["lgpl21-grant", "gpl-warranty"]),
    ("LGPL-3.0-or-later", ["lgpl3-grant", "gpl-warranty"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("ISC", ["isc-grant", "isc-warranty"]),
    ("0BSD", ["0bsd-grant", "isc-warranty"]),
    ("MPL-2.0", ["mpl-notice", "mpl-copy"]),
    ("Unlicense", ["unlicense-notice", "unlicense-grant"]),
    ("Zlib", ["zlib-warranty", "zlib-grant"]),
    ("MIT", ["mit-grant"]),
    ("MIT", ["mit-notice"]),
    ("Apache-2.0", ["apache-notice"]),
    ("Apache-2.0", ["apache-title"]),
    ("GPL-3.0-or-later", ["gpl3-grant"]),
    ("GPL-3.0-only", ["gpl3-notice"]),
    ("GPL-3.0-only", ["gpl3-title"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-notice"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-notice"]),
    ("CC-BY-4.0", ["cc-by-notice"]),
    ("BSD-2-Clause", ["bsd-grant"]),
    ("MIT", ["mit-title"]),
    *[(name, [f"{part}-{kind}"]) for name, part, kinds in (
        ("AGPL-3.0-or-later", "agpl3", "grant"), ("AGPL-3.0-only", "agpl3", "title"), ("GPL-2.0-or-later", "gpl2", "grant"), ("GPL-2.0-only", "gpl2", "title"),
        ("LGPL-2.1-or-later", "lgpl21", "grant"), ("LGPL-2.1-only", "lgpl21", "title"), ("LGPL-3.0-or-later", "lgpl3", "grant"), ("LGPL-3.0-only", "lgpl3", "title"),
        ("BSD-2-Clause", "bsd2", "title"), ("BSD-3-Clause", "bsd3", "title"), ("ISC", "isc", "grant title"), ("0BSD", "0bsd", "grant"), ("MPL-2.0", "mpl", "notice title"),
        ("Unlicense", "unlicense", "notice title"), ("CC0-1.0", "cc0", "waiver title"), ("Zlib", "zlib", "grant"), ("BSL-1.0", "bsl", "notice title"), ("EPL-2.0", "epl2", "notice title"),
        ("Artistic-2.0", "artistic2", "title"), ("CC-BY-ND-4.0", "cc-by-nd", "notice"), ("CC-BY-NC-SA-4.0", "cc-by-nc-sa", "notice"), ("CC-BY-NC-ND-4.0", "cc-by-nc-nd", "notice"),
    ) for kind in kinds.split()],
    *[(tag, [f"tag {w}"]) for tag, w in TAG_WORDS.items()],
    ("Proprietary", ["reserved"]),
]
#: A word of every known sentence; sentences without one are not normalised. Checked by a test.
ANCHOR = "(?i)licen[cs]e|permission|warrant|reserved|distribut|compliance|mpl|public domain|cc0"
#: Labels of list items are no sentences.
LABEL = "^([0-9]{1,3}|[a-z])$"


#: Marks of where a sentence may (line end, punctuation) or must (blank line) end. None is a letter, digit or blank.
LINE, STOP, BLANK = "/", "|", "_"


def marked(text: Column) -> Column:
    """The normalised text with one mark at each possible end of a sentence, and at both ends."""
    t = F.regexp_replace(F.lower(text), r"\r\n?", "\n")
    # What the text itself has of the marks goes first. Runs are only looked at from their first character.
    steps = [("[/|_<>]", " "), (r"\n[ \t]*\n\s*", BLANK), (r"[.!?:;][ \t]*(?=\n|_)|[.!?:;][ \t]+", STOP), ("\n", LINE), ("[^a-z0-9/|_]+", " "), ("(?<![ /|])[ /|]*_[ /|_]*", BLANK), (r"(?<![ /])[ /]*\|[ /|]*", STOP), ("(?<! ) */[ /]*", LINE)]
    for pattern, to in steps:
        t = F.regexp_replace(t, pattern, to)
    return F.concat(F.lit(STOP), F.trim(t), F.lit(STOP))


def identifiers(text: Column) -> Column:
    """Identifiers of the known sentences in order, "-" for what stands between them; null counts as empty."""
    text = F.coalesce(text, F.lit(""))

    def known(t: Column) -> Column:
        # Longer sentences first: a shorter one may be the end of a longer one's wrapped line.
        for sentence, ident in sorted(SENTENCES.items(), key=lambda x: -len(x[0])):
            t = F.regexp_replace(t, f"(?<=[/|_]){sentence.replace(' ', '[ /|]')}(?=[/|_])", f"<{ident}>")
        tags = "|".join(sorted(TAG_WORDS.values(), key=lambda x: -len(x)))
        return F.regexp_replace(t, f"(?<=[/|_]){TAG_HEAD.replace(' ', '[ /|]')}[ /|]({tags})(?=[/|_])", "<tag $1>")

    parts = F.filter(F.split(known(marked(text)), "[/|_]"), lambda s: (s != "") & ~s.rlike(LABEL))
    found = F.transform(parts, lambda s: F.when(F.startswith(s, F.lit("<")), F.substring(s, 2, F.length(s) - 2)).otherwise(F.lit("-")))
    return F.when(text.rlike(ANCHOR), found).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, text: str = "text", rules: list[tuple[str, list[str]]] = RULES) -> DataFrame:
    """docs with `licence`: struct of identifiers (those known, in text order), rules (numbers of the rules that matched, in
    rule order) and licences (each once, in rule order).

    Null and empty texts match nothing; texts of any length are scanned whole; a rule that matches several times counts
    once, and of rules that could match the same sentences the one that stands first does; repeated rows are scanned
    alike; a column already named licence is replaced, any other name passes through; an empty table stays empty.
    """
    docs = docs.drop("licence")

    def match(ids: Column) -> Column:
        # Every identifier stands between its own bars, so that neither ends nor neighbours are shared by two matches.
        state = F.struct(F.concat(F.lit("|"), F.array_join(ids, "||"), F.lit("|")).alias("s"), F.array().cast("array<int>").alias("hit"))
        steps = F.array(*[F.struct(F.lit("".join(f"|{i}|" for i in seq)).alias("p"), F.lit(k).alias("k")) for k, (_, seq) in enumerate(rules)])
        return F.aggregate(steps, state, lambda a, r: F.struct(F.replace(a["s"], r["p"], F.lit("|-|")).alias("s"), F.when(F.contains(a["s"], r["p"]), F.concat(a["hit"], F.array(r["k"]))).otherwise(a["hit"]).alias("hit")), lambda a: a["hit"])

    names = F.array(*[F.lit(name) for name, _ in rules])
    one = lambda ids: let(F.when(F.size(F.array_remove(ids, "-")) > 0, match(ids)).otherwise(F.array().cast("array<int>")), lambda hit: F.struct(F.array_remove(ids, "-").alias("identifiers"), hit.alias("rules"), F.array_distinct(F.transform(hit, lambda k: F.get(names, k))).alias("licences")))
    return docs.select("*", let(identifiers(F.col(text)), one).alias("licence"))
