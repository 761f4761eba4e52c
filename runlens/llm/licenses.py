"""Licence scan by sentence rules.

A text is normalised to words and the boundaries between lines and sentences. A known sentence
stands where its words run from one boundary to another, across any boundaries in between, so
it may be wrapped over lines or have a colon inside; sentences found become identifiers. The
identifiers, in the order of the text, are then matched against ordered rules: a rule names a
sequence of identifiers, earlier rules take theirs first, and what a rule has taken no later
rule sees. Everything is one projection; nothing is shuffled.

Defined cases: a null or empty text has no sentences; sentences that are not known are
passed over and do not part a sequence; an identifier that no rule takes is reported among
the sentences only; a header that names no version is reported by its family; an SPDX tag is
known if it names one licence, not an expression of several; repeated rows are scanned each;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import BLANK, ascii_lower, let

# Sentences of public licences, by identifier.
SENTENCES = {
    "all-rights": "All rights reserved.",
    "mit-released": "Released under the MIT License.",
    "mit-under": "Licensed under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "apache-under": "Licensed under the Apache License, Version 2.0.",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-comply": "you may not use this file except in compliance with the License.",
    "apache-obtain": "You may obtain a copy of the License at",
    "apache-unless": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl3-under": "Licensed under the GNU General Public License, version 3.",
    "gpl2-under": "Licensed under the GNU General Public License, version 2.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl-see": "See the GNU General Public License for more details.",
    "bsd-redistribute": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0.",
    "cc-by-4": "Licensed under CC BY 4.0.",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0.",
    "cc0": "Released under CC0 1.0.",
}

#: Licence and the sentences it takes, tried in this order.
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-under",)),
    ("Apache-2.0", ("apache-header", "apache-comply", "apache-obtain", "apache-unless", "apache-see")),
    ("Apache-2.0", ("apache-header",)),
    ("Apache-2.0", ("apache-under",)),
    ("GPL", ("gpl-hope", "gpl-see")),
    ("GPL-3.0", ("gpl3-work",)),
    ("GPL-3.0", ("gpl3-under",)),
    ("GPL-2.0", ("gpl2-under",)),
    ("BSD-2-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary")),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC0-1.0", ("cc0",)),
    ("all-rights-reserved", ("all-rights",)),
)

# Sentences that tell versions, and those of further licences.
VERSION_SENTENCES = {
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "gpl3-only": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "lib-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "lgpl-see": "See the GNU Lesser General Public License for more details.",
    "agpl-see": "See the GNU Affero General Public License for more details.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-grant-and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl2-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl11-subject": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\");",
    "epl1-made": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at",
    "epl2-made": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "unlicense-free": "This is free and unencumbered software released into the public domain.",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-freely": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "boost-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
}

ALL_SENTENCES = SENTENCES | VERSION_SENTENCES

# Licences and the names that sentences give them.
NAMES = {
    "MIT": ("MIT License", "MIT"),
    "ISC": ("ISC License", "ISC"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License", "FreeBSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "Modified BSD License"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "MPL-1.1": ("Mozilla Public License, Version 1.1", "Mozilla Public License 1.1"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0"),
    "EPL-1.0": ("Eclipse Public License, Version 1.0", "Eclipse Public License 1.0", "Eclipse Public License v1.0"),
    "EPL-2.0": ("Eclipse Public License, Version 2.0", "Eclipse Public License 2.0", "Eclipse Public License v2.0"),
    "Unlicense": ("Unlicense",),
    "Zlib": ("zlib License",),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal License"),
}
FAMILIES = {
    "GPL": ("GNU General Public License", ("1", "2", "3")),
    "LGPL": ("GNU Lesser General Public License", ("2.1", "3")),
    "AGPL": ("GNU Affero General Public License", ("3",)),
}
CC_PARTS = {"BY": "Attribution", "NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}
CC_KINDS = ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")
UNDER = (
    "Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}",
    "Distributed under the {}", "This project is licensed under the {}", "This work is licensed under the {}",
    "This work is licensed under a {}", "This software is licensed under the {}", "This file is licensed under the {}",
)
FREE = (
    "This {} is free software you can redistribute it and/or modify it under the terms of the {} as published by the "
    "Free Software Foundation"
)


def _names() -> dict[str, list[str]]:
    found = {spdx: list(names) for spdx, names in NAMES.items()}
    for short, (name, versions) in FAMILIES.items():
        for v in versions:
            spdx = f"{short}-{v if '.' in v else v + '.0'}"
            plain = [f"{name}, version {v}", f"{name} v{v}", f"{short}v{v}", f"{short} v{v}"]
            found[spdx] = plain
            found[f"{spdx}-or-later"] = [f"{p} {e}" for p in plain for e in ("or later", "or (at your option) any later version")]
    for kind in CC_KINDS:
        words = "-".join(CC_PARTS[p] for p in kind.split("-"))
        for v in ("3.0", "4.0"):
            long = f"Creative Commons {words} {v}"
            suffixes = ("Unported License",) if v == "3.0" else ("International License", "International")
            found[f"CC-{kind}-{v}"] = [f"CC {kind} {v}", f"CC {kind} {v} License", long, f"{long} License"]
            found[f"CC-{kind}-{v}"] += [f"{long} {e}" for e in suffixes]
    return found


def _named() -> tuple[dict[str, str], list[tuple[str, str]]]:
    """Normal forms of sentences that name a licence, with their identifiers; licences and these identifiers."""
    forms: dict[str, str] = {}
    rules = []
    for spdx, names in _names().items():
        i = f"named-{spdx}"
        rules.append((spdx, i))
        tags = [spdx] + ([f"{spdx}-only"] if spdx.split("-")[0] in FAMILIES and "later" not in spdx else [])
        for text in [u.format(n) for n in names for u in UNDER] + [f"SPDX-License-Identifier: {t}" for t in tags]:
            forms.setdefault(normal_form(text), i)
    return forms, rules


def _headers() -> tuple[dict[str, str], list[tuple[str, str, str]]]:
    """The same for headers of free software; licences, identifiers and families."""
    forms: dict[str, str] = {}
    rules = []
    for short, (name, versions) in FAMILIES.items():
        for v in versions:
            spdx = f"{short}-{v if '.' in v else v + '.0'}"
            later = ("either version {} of the License, or (at your option) any later version", "either version {}, or (at your option) any later version")
            for licence, ends in ((f"{spdx}-or-later", later), (spdx, ("version {}", "version {} of the License"))):
                rules.append((licence, f"header-{licence}", short))
                for thing in ("program", "library", "software", "file"):
                    for end in ends:
                        forms[normal_form(f"{FREE.format(thing, name)}, {end.format(v)}")] = f"header-{licence}"
    return forms, rules


def normal_form(sentence: str) -> str:
    """The words of a sentence, as ``_known`` has them."""
    kept = "".join(c if c.isascii() and c.isalnum() else " " for c in sentence).lower()
    return " ".join(kept.split())


NAMED, _BY_NAME = _named()
HEADERS, _BY_HEADER = _headers()
_WARRANTIES = {
    "GPL": (("gpl-hope", "gpl-see"),),
    "LGPL": (("lib-hope", "lgpl-see"), ("gpl-hope", "lgpl-see")),
    "AGPL": (("gpl-hope", "agpl-see"),),
}
_OWN_HEADERS = (
    ("GPL-3.0-or-later", "gpl-free", "GPL"),
    ("GPL-2.0-or-later", "gpl2-free", "GPL"),
    ("GPL-2.0", "gpl2-only", "GPL"),
    ("GPL-3.0", "gpl3-only", "GPL"),
    *_BY_HEADER,
)
ALL_RULES = (
    *((name, (i, *rest)) for name, i, family in _OWN_HEADERS for rest in _WARRANTIES[family]),
    *((name, (i,)) for name, i, _ in _OWN_HEADERS),
    ("BSD-3-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-names")),
    *RULES,
    *((family, rest) for family in ("LGPL", "AGPL") for rest in _WARRANTIES[family]),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-grant-and",)),
    ("MPL-2.0", ("mpl2-form",)),
    ("MPL-1.1", ("mpl11-subject",)),
    ("EPL-1.0", ("epl1-made",)),
    ("EPL-2.0", ("epl2-made",)),
    ("Unlicense", ("unlicense-free",)),
    ("Zlib", ("zlib-as-is", "zlib-freely")),
    ("BSL-1.0", ("boost-grant",)),
    *((spdx, (i,)) for spdx, i in _BY_NAME),
)
#: Identifiers by the normal form of their sentences.
KNOWN = {**NAMED, **HEADERS, **{normal_form(text): i for i, text in ALL_SENTENCES.items()}}

#: Every known sentence has one of these, so most sentences need no further look. What stands
#: between two words is open here as it is for the sentences: they may be wrapped.
MARKS = (
    "(?i)licen[sc]|copyright|rights[^a-z0-9]+reserved|redistribut|warrant|permission|public[^a-z0-9]+domain"
    "|liab|(?:released|distributed)[^a-z0-9]+under|compliance"
)
ENDS = r"([.;:!?])" + BLANK + "+"


def sequence_text(ids: tuple[str, ...]) -> str:
    return "".join(f"<{i}>" for i in ids)


def pattern(forms: Iterable[str], between: str = "(?: L)* ") -> str:
    """One expression for all normal forms, which shares the beginnings they have in common. Of two
    forms that begin alike the longer is preferred: a shorter one may end at a line's end inside it."""
    root: dict = {}
    for form in forms:
        node = root
        for word in form.split(" "):
            node = node.setdefault(word, {})
        node[""] = {}

    def text(node: dict) -> str:
        parts = [w + text(n) for w, n in sorted(node.items()) if w]
        if not parts:
            return ""
        rest = "(?:" + "|".join(parts) + ")" if len(parts) > 1 else parts[0]
        if node is root:
            return rest
        return f"(?:{between}{rest})?" if "" in node else between + rest

    return text(root)


def _known(text: Column, known: dict[str, str]) -> Column:
    # No upper case is left of the text, so an L marks a boundary.
    cut = F.regexp_replace(F.replace(ascii_lower(text), F.lit("\n"), F.lit("L")), ENDS, "$1L")
    spaced = F.concat(F.lit("L "), F.replace(cut, F.lit("L"), F.lit(" L ")), F.lit(" L"))
    words = F.regexp_replace(spaced, "[^a-z0-9L]+", " ")
    names = F.create_map(*(F.lit(x) for k, i in known.items() for x in (k, i)))
    found = F.transform(
        F.regexp_extract_all(words, F.lit(f"(?<=L )(?:{pattern(known)})(?= L)"), F.lit(0)),
        lambda s: F.try_element_at(names, F.replace(s, F.lit(" L"), F.lit(""))),
    )
    return F.when(text.rlike(MARKS), found).otherwise(F.expr("cast(array() as array<string>)"))


def _licences(ids: Column, rules: tuple[tuple[str, tuple[str, ...]], ...]) -> Column:
    """Distinct licences in the order of the rules that found them."""
    table = F.array(
        *(F.struct(F.lit(name).alias("name"), F.lit(sequence_text(seq)).alias("seq")) for name, seq in rules)
    )
    begun = F.struct(
        F.array_join(F.transform(ids, lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "").alias("rest"),
        F.expr("cast(array() as array<string>)").alias("found"),
    )

    def step(state: Column, rule: Column) -> Column:
        hit = F.contains(state["rest"], rule["seq"])
        return F.struct(
            F.replace(state["rest"], rule["seq"], F.lit("|")).alias("rest"),
            F.when(hit, F.array_append(state["found"], rule["name"])).otherwise(state["found"]).alias("found"),
        )

    taken = F.aggregate(table, begun, step)["found"]
    return F.when(F.size(ids) > 0, F.array_distinct(taken)).otherwise(F.expr("cast(array() as array<string>)"))


def scan(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    known: dict[str, str] = KNOWN,
    rules: tuple[tuple[str, tuple[str, ...]], ...] = ALL_RULES,
) -> DataFrame:
    """Per document: ``doc_id``, known ``sentences`` in order, ``licences``."""
    return (
        docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
        .select("doc_id", _known(F.col("t"), known).alias("sentences"))
        .select("doc_id", "sentences", let(F.col("sentences"), lambda ids: _licences(ids, rules)).alias("licences"))
    )
