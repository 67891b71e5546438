"""Licence scan by sentence rules.

Text is cut into sentences (after . ! ? : or ; before white space, but not after a lone "v."; line ends inside
a sentence are white space).  Sentences with a marker word are normalised: A-Z lower-cased, everything but
letters and digits to single blanks.  Known sentences are found anywhere in them, between word borders: marks
may be missing, as after the URL line of a notice, or differ.  The identifiers of a document, in order, are matched against the rules: at each place the
first rule in order whose sequence stands there takes it; identifiers that no rule takes stay unmatched.

Defined cases: null and empty texts have no identifiers and empty results.  Each row gives one row, also
repeated ones; other columns are not looked at.  Everything is done in the row: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import ascii_lower

# Normalised sentences of well-known licences, by identifier.
SENTENCES = {
    "ap-name": "licensed under the apache license version 2 0",
    "ap-head": "licensed under the apache license version 2 0 the license",
    "ap-use": "you may not use this file except in compliance with the license",
    "ap-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "ap-law": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "ap-see": "see the license for the specific language governing permissions and limitations under the license",
    "bsd-use": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-src": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-bin": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "cc-by": "licensed under cc by 4 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "gpl-name": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software",
    "gpl-terms2": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl-v3": "either version 3 of the license or at your option any later version",
    "gpl-v2": "either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl-merch": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "mit-name": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mpl-form": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
}
# Rules in order, each a sequence of identifiers and the licence it stands for.
RULES = (
    (("ap-head", "ap-use", "ap-copy", "ap-law", "ap-see"), "Apache-2.0"),
    (("ap-head", "ap-use", "ap-copy"), "Apache-2.0"),
    (("ap-name",), "Apache-2.0"),
    (("bsd-use", "bsd-src", "bsd-bin", "bsd-name"), "BSD-3-Clause"),
    (("bsd-use", "bsd-src", "bsd-bin"), "BSD-2-Clause"),
    (("cc-by",), "CC-BY-4.0"),
    (("cc-by-nc",), "CC-BY-NC-4.0"),
    (("cc-by-sa",), "CC-BY-SA-4.0"),
    (("gpl-free", "gpl-terms2", "gpl-v3"), "GPL-3.0-or-later"),
    (("gpl-free", "gpl-terms2", "gpl-v2"), "GPL-2.0-or-later"),
    (("gpl-hope", "gpl-merch", "gpl-see"), "GPL-notice"),
    (("gpl-name",), "GPL-3.0-only"),
    (("mit-grant", "mit-notice", "mit-as-is"), "MIT"),
    (("mit-grant", "mit-notice"), "MIT"),
    (("mit-name",), "MIT"),
    (("mpl-form", "mpl-copy"), "MPL-2.0"),
    (("mpl-form",), "MPL-2.0"),
)
#: Every known sentence holds one of these (a test sees to it).
MARKERS = ("licen", "permission", "redistribut", "software", "warranty", "mpl")
#: End of a sentence for the SQL, which has no look-behind and so also cuts after "v.".
END = r"([.!?:;])[ \t-\r]+"
CUT = r"((?<![^A-Za-z0-9][vV](?=\.))[.!?:;])[ \t-\r]+"
#: A version that is only the least one does not name that version alone.
NOT_BEFORE = {"gpl-name": "(?! (?:or|and) (?:at your option )?(?:any )?later)"}


def marker_pattern() -> str:
    """Any marker, in either case."""
    return "|".join("".join(f"[{c}{c.upper()}]" for c in m) for m in MARKERS)


def known_pattern() -> str:
    """A known sentence at the end of a normalised one, for the SQL; longer ones first."""
    return "(?:^| )(" + "|".join(sorted(SENTENCES.values(), key=len, reverse=True)) + ")$"


def anywhere_pattern() -> str:
    """A known sentence between word borders; longer ones first."""
    longest = sorted(SENTENCES.items(), key=lambda x: len(x[1]), reverse=True)
    return "(?:^| )(" + "|".join(s + NOT_BEFORE.get(i, "") for i, s in longest) + ")(?= |$)"


def rule_pattern() -> str:
    """Any rule's sequence in a text of identifiers that each end with a comma."""
    return "(?:" + "|".join("".join(f"{s}," for s in sequence) for sequence, _ in RULES) + ")"


def lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))[key]


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    sentences = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), CUT, "$1\u0001"), "\u0001", -1)
    marked = F.filter(sentences, lambda s: s.rlike(marker_pattern()))
    plain = F.transform(marked, lambda s: F.btrim(F.regexp_replace(ascii_lower(s), "[^a-z0-9]+", " ")))
    known = F.flatten(F.transform(plain, lambda s: F.regexp_extract_all(s, F.lit(anywhere_pattern()), F.lit(1))))
    return F.transform(known, lambda s: lookup({v: k for k, v in SENTENCES.items()}, s))


def scan_licences(docs: DataFrame) -> DataFrame:
    """doc_id, sentences (identifiers), licences (distinct, in order of appearance) and unmatched identifiers."""
    found = docs.select("doc_id", sentence_ids(F.col("text")).alias("sentences"))
    chain = found.withColumn("_chain", F.concat(F.array_join("sentences", ","), F.lit(",")))
    taken = F.regexp_extract_all("_chain", F.lit(r"(?<![^,])" + rule_pattern()), F.lit(0))
    rules = {"".join(f"{s}," for s in sequence): licence for sequence, licence in RULES}
    rest = F.split(F.regexp_replace("_chain", r"(?<![^,])" + rule_pattern(), ""), ",")
    return chain.select(
        "doc_id",
        "sentences",
        F.array_distinct(F.transform(taken, lambda s: lookup(rules, s))).alias("licences"),
        F.filter(rest, lambda s: s != "").alias("unmatched"),
    )
