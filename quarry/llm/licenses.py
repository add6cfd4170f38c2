"""Licence scans by sentence rules, in DataFrame functions only.

A text's sentences are normalised and looked up among known licence sentences;
the identifiers found, in order, are then matched by ordered rules.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised sentences (lower case, letters and digits only, opening subject left out) and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "ApacheNamed",
    "licensed under the apache license version 2 0 the license": "ApacheNamed",
    "apache license version 2 0": "ApacheTitle",
    "you may not use this file except in compliance with the license": "ApacheCompliance",
    "you may obtain a copy of the license at": "ApacheCopyAt",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "ApacheAsIs",
    "see the license for the specific language governing permissions and limitations under the license": "ApacheSeeLicense",
    "released under the mit license": "MITNamed",
    "licensed under the mit license": "MITNamed",
    "distributed under the mit license": "MITNamed",
    "mit license": "MITTitle",
    "the mit license": "MITTitle",
    "the mit license mit": "MITTitle",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MITGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MITNotice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MITAsIs",
    "licensed under the bsd license": "BSDNamed",
    "released under the bsd license": "BSDNamed",
    "licensed under the bsd 3 clause license": "BSD3Named",
    "licensed under the bsd 2 clause license": "BSD2Named",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSDGrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSDSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSDBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSDEndorse",
    "licensed under the gnu general public license version 3": "GPL3Named",
    "licensed under the gnu general public license version 3 0": "GPL3Named",
    "licensed under the gnu general public license version 2": "GPL2Named",
    "licensed under the gnu lesser general public license version 3": "LGPL3Named",
    "licensed under the gnu affero general public license version 3": "AGPL3Named",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GPL3OrLater",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "GPL2OrLater",
    "free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GPL3OrLater",
    "free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "GPL2OrLater",
    "distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GPLNoWarranty",
    "distributed in the hope that it will be useful but without any warranty": "GPLNoWarranty",
    "subject to the terms of the mozilla public license v 2 0": "MPL2Named",
    "subject to the terms of the mozilla public license version 2 0": "MPL2Named",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "MPL2CopyAt",
    "licensed under cc by nc 4 0": "CCByNc4Named",
    "licensed under cc by nc sa 4 0": "CCByNcSa4Named",
    "licensed under cc by sa 4 0": "CCBySa4Named",
    "licensed under cc by 4 0": "CCBy4Named",
    "licensed under a creative commons attribution 4 0 international license": "CCBy4Named",
    "licensed under a creative commons attribution sharealike 4 0 international license": "CCBySa4Named",
    "licensed under a creative commons attribution noncommercial 4 0 international license": "CCByNc4Named",
    "licensed under cc0 1 0": "CC0Named",
    "free and unencumbered software released into the public domain": "UnlicenseGrant",
    "all rights reserved": "AllRightsReserved",
    "spdx license identifier apache 2 0": "ApacheNamed",
    "spdx license identifier mit": "MITNamed",
    "spdx license identifier gpl 3 0 only": "GPL3Named",
    "spdx license identifier gpl 3 0 or later": "GPL3OrLater",
    "spdx license identifier gpl 2 0 only": "GPL2Named",
    "spdx license identifier bsd 3 clause": "BSD3Named",
    "spdx license identifier bsd 2 clause": "BSD2Named",
}

# A rule applies where its identifiers are there in this order, others may lie between; it takes them away, and the next rule sees the rest.
RULES = [
    ("Apache-2.0", ["ApacheNamed", "ApacheCompliance", "ApacheCopyAt", "ApacheAsIs", "ApacheSeeLicense"]),
    ("Apache-2.0", ["ApacheNamed", "ApacheCompliance"]),
    ("Apache-2.0", ["ApacheNamed"]),
    ("Apache-2.0", ["ApacheTitle"]),
    ("MIT", ["MITTitle", "MITGrant", "MITNotice", "MITAsIs"]),
    ("MIT", ["MITGrant", "MITNotice", "MITAsIs"]),
    ("MIT", ["MITGrant", "MITNotice"]),
    ("MIT", ["MITNamed"]),
    ("MIT", ["MITTitle"]),
    ("BSD-3-Clause", ["BSDGrant", "BSDSource", "BSDBinary", "BSDEndorse"]),
    ("BSD-2-Clause", ["BSDGrant", "BSDSource", "BSDBinary"]),
    ("BSD-3-Clause", ["BSD3Named"]),
    ("BSD-2-Clause", ["BSD2Named"]),
    ("LicenseRef-BSD", ["BSDNamed"]),
    ("AGPL-3.0", ["AGPL3Named"]),
    ("LGPL-3.0", ["LGPL3Named"]),
    ("GPL-3.0-or-later", ["GPL3OrLater", "GPLNoWarranty"]),
    ("GPL-3.0-or-later", ["GPL3OrLater"]),
    ("GPL-2.0-or-later", ["GPL2OrLater", "GPLNoWarranty"]),
    ("GPL-2.0-or-later", ["GPL2OrLater"]),
    ("GPL-3.0-only", ["GPL3Named"]),
    ("GPL-2.0-only", ["GPL2Named"]),
    ("MPL-2.0", ["MPL2Named", "MPL2CopyAt"]),
    ("MPL-2.0", ["MPL2Named"]),
    ("CC-BY-NC-SA-4.0", ["CCByNcSa4Named"]),
    ("CC-BY-NC-4.0", ["CCByNc4Named"]),
    ("CC-BY-SA-4.0", ["CCBySa4Named"]),
    ("CC-BY-4.0", ["CCBy4Named"]),
    ("CC0-1.0", ["CC0Named"]),
    ("Unlicense", ["UnlicenseGrant"]),
    ("All-Rights-Reserved", ["AllRightsReserved"]),
]

# Names that follow "licensed under", and their identifiers.
_NAMES = {
    "ApacheNamed": ["apache license version 2 0", "apache license 2 0", "apache license v2 0", "apache 2 0 license", "apache 2 0"],
    "MITNamed": ["mit license", "mit", "mit license mit"],
    "BSDNamed": ["bsd license", "bsd"],
    "BSD3Named": ["bsd 3 clause license", "bsd 3 clause", "3 clause bsd license", "new bsd license", "modified bsd license"],
    "BSD2Named": ["bsd 2 clause license", "bsd 2 clause", "2 clause bsd license", "simplified bsd license"],
    "MPL2Named": ["mozilla public license version 2 0", "mozilla public license v 2 0", "mozilla public license 2 0", "mpl 2 0"],
    "ISCNamed": ["isc license", "isc"],
    "Boost1Named": ["boost software license version 1 0", "boost software license 1 0", "boost software license", "bsl 1 0"],
    "CC0Named": ["cc0 1 0", "cc0 1 0 universal", "cc0", "creative commons cc0 1 0 universal"],
    "UnlicenseNamed": ["unlicense"],
    "CCByNc4Named": ["cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"],
    "CCByNcSa4Named": ["cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0 international license"],
    "CCBySa4Named": ["cc by sa 4 0"],
    "CCBy4Named": ["cc by 4 0"],
}
_SPDX = {"ISCNamed": "isc", "Boost1Named": "bsl 1 0", "MPL2Named": "mpl 2 0", "CC0Named": "cc0 1 0", "UnlicenseNamed": "unlicense", "CCBy4Named": "cc by 4 0", "CCBySa4Named": "cc by sa 4 0", "CCByNc4Named": "cc by nc 4 0", "CCByNcSa4Named": "cc by nc sa 4 0"}
# Short name, words of the long one, versions as identifiers and as they are written.
_GNU = [("GPL", "gnu general public license", {"2": ["2", "2 0"], "3": ["3", "3 0"]}), ("LGPL", "gnu lesser general public license", {"2": ["2", "2 0"], "21": ["2 1"], "3": ["3", "3 0"]}), ("LGPL", "gnu library general public license", {"2": ["2", "2 0"]}), ("AGPL", "gnu affero general public license", {"3": ["3", "3 0"]})]
_TERMS = "you can redistribute it and or modify it under the terms of the "
_FSF = " as published by the free software foundation"


def _more_sentences() -> dict[str, str]:
    found = {f"licensed under {name}": i for i, names in _NAMES.items() for name in names}
    found |= {f"spdx license identifier {name}": i for i, name in _SPDX.items()}
    found |= {
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISCGrant",
        "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISCGrant",
        "isc license": "ISCTitle",
        "boost software license version 1 0 august 17th 2003": "Boost1Title",
        "boost software license version 1 0": "Boost1Title",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "Boost1Grant",
    }
    for short, long, versions in _GNU:
        low = short.lower()
        found[f"{_TERMS}{long}{_FSF}"] = f"{short}Terms"
        for v, written in versions.items():
            for w in written:
                found[f"either version {w} of the license or at your option any later version"] = f"Either{v}"
                found[f"{_TERMS}{long} version {w}{_FSF}"] = f"{short}{v}Named"
                found[f"{_TERMS}{long}{_FSF} version {w} of the license"] = f"{short}{v}Named"
                found[f"{_TERMS}{long}{_FSF} either version {w} of the license or at your option any later version"] = f"{short}{v}OrLater"
                for name in (f"{long} version {w}", f"{long} v{w}", f"{long} {w}", f"{low} {w}", f"{low}v{w}", f"{low} v{w}", f"gnu {low} v{w}", f"gnu {low} {w}", f"gnu {low}v{w}", f"gnu {low} version {w}", f"{low} version {w}"):
                    found |= {f"licensed under {name}": f"{short}{v}Named", f"licensed under {name} only": f"{short}{v}Named"}
                    found |= {f"licensed under {name} {tail}": f"{short}{v}OrLater" for tail in ("or later", "or any later version", "or at your option any later version")}
            full = written[-1]
            found |= {f"spdx license identifier {low} {full}": f"{short}{v}Named", f"spdx license identifier {low} {full} only": f"{short}{v}Named", f"spdx license identifier {low} {full} or later": f"{short}{v}OrLater"}
    return found


#: Each known sentence has one of these words: a text or sentence without them needs no lookup.
TRIGGER = r"(?i)licen[cs]e|permission|copyright|redistribut|warrant|mpl|cc0|unencumbered|rights reserved|mozilla|gpl|under (?:the )?(?:isc|mit|bsd|apache|boost|cc by)"
#: Any opening before a statement of licence, unless it denies it; and the ways to begin one.
_OPENING = r"^.*\b(?:is|are)(?: also| dual)? (?=(?:licensed|released|distributed|published|provided|available|made available) under )|^.* (?=you can redistribute it and or modify it under the terms of the )"
_UNDER = r"^(?:licensed|released|distributed|published|provided|available|made available) under (?:the terms of )?(?:the |an? )?"
#: What a sentence may open with before the words of SENTENCES.
_SUBJECT = r"^(?:copyright(?: c)?(?: [0-9]+)?(?: [a-z0-9]+){0,8}? (?=all rights reserved$))|^(?:this|the|these|our|your)?(?: ?source)? ?(?:code|work|software|file|files|program|project|library|package|document|documentation|text|content|module|site)? ?(?:is|are)(?: also)? "


_BREAK, _WRAP = r"([.!?;]|(?<![Ii]dentifier):)\s+", r"(?<=[^.!?;:\s])[ \t]*\r?\n(?![ \t]*\r?\n)[ \t#*/-]*"


def normal(sentence: str) -> str:
    """A sentence as the table has it: lower case, letters and digits, without what it opens with; see _normal."""
    plain = re.sub("[^a-z0-9]+", " ", sentence.lower()).strip(" ")
    told = re.sub(_SUBJECT, "", re.sub(_OPENING, "", re.sub(r"\blicence", "license", plain)))
    return re.sub(r"^(licensed under .*?) see .*$", r"\1", re.sub(_UNDER, "licensed under ", told))


def _texts() -> dict[str, list[list[str]]]:
    """The licences of license_texts.txt: the normal sentences of each of their lines; those without a trigger word tell nothing and are left out."""
    found: dict[str, list[list[str]]] = {}
    with open(os.path.join(os.path.dirname(__file__), "license_texts.txt"), encoding="utf-8") as f:
        for line in f.read().splitlines():
            if line.startswith("== "):
                own = found.setdefault(line[3:], [])
            elif line and not line.startswith("#"):
                parts = re.split(r"\s*\n\s*", re.sub(_BREAK, r"\1\n", line))
                own.append([normal(x) for x in parts if re.search(TRIGGER, x) and normal(x)])
    return found


def _learn() -> dict[str, str]:
    """Adds the sentences of the licence texts, their titles as names, and a rule for each whole text; identifiers that one licence alone has."""
    homes: dict[str, set[str]] = {}
    whole = []
    for name, lines in _texts().items():
        ids, short = [], re.sub("[^A-Za-z0-9]", "_", name)
        known = [normal(name.replace("-", " ")), *(lines[0] if lines else [])]
        for form in [f"licensed under {x}" for x in known] + [f"spdx license identifier {known[0]}"]:
            homes.setdefault(SENTENCES.setdefault(re.sub(_UNDER, "licensed under ", form), f"{short}Named"), set()).add(name)
        for sentence in (x for line in lines for x in line):
            i = SENTENCES.setdefault(sentence, f"{short}_{len(ids) + 1}")
            homes.setdefault(i, set()).add(name)
            ids += [i] if i not in ids else []
        if len(ids) > 1:
            whole.append((name, ids))
    RULES[:0] = sorted(whole, key=lambda x: -len(x[1]))
    ruled = {i for _, ids in RULES[len(whole) :] for i in ids}
    return {i: next(iter(names)) for i, names in homes.items() if len(names) == 1 and i not in ruled}


SENTENCES |= {k: v for k, v in _more_sentences().items() if k not in SENTENCES}
RULES += [
    *((f"{short}-{v}-or-later", need) for short, v, i in (("GPL", "2.0", "2"), ("GPL", "3.0", "3"), ("LGPL", "2.0", "2"), ("LGPL", "2.1", "21"), ("LGPL", "3.0", "3"), ("AGPL", "3.0", "3")) for need in ([f"{short}Terms", f"Either{i}"], [f"{short}{i}OrLater"])),
    ("LGPL-2.1", ["LGPL21Named"]),
    ("LGPL-2.0", ["LGPL2Named"]),
    ("ISC", ["ISCTitle", "ISCGrant"]),
    ("ISC", ["ISCGrant"]),
    ("ISC", ["ISCNamed"]),
    ("ISC", ["ISCTitle"]),
    ("BSL-1.0", ["Boost1Title", "Boost1Grant"]),
    ("BSL-1.0", ["Boost1Grant"]),
    ("BSL-1.0", ["Boost1Named"]),
    ("BSL-1.0", ["Boost1Title"]),
    ("Unlicense", ["UnlicenseNamed"]),
]

#: What an identifier that no rule took tells by itself.
TELLING = _learn()


def _normal(sentence: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))
    told = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"\blicence", "license"), _OPENING, ""), _SUBJECT, "")
    return F.regexp_replace(F.regexp_replace(told, _UNDER, "licensed under "), r"^(licensed under .*?) see .*$", "$1")


def _sentences(text: Column) -> Column:
    return F.split(F.regexp_replace(text, _BREAK, "$1\n"), r"\s*\n\s*")


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of *text* in order: first those of its paragraphs' sentences, then of single lines not found so."""
    table = _map({re.sub(_UNDER, "licensed under ", k): v for k, v in SENTENCES.items()})
    known = lambda parts: F.array_compact(F.transform(F.filter(parts, lambda s: s.rlike(TRIGGER)), lambda s: F.try_element_at(table, _normal(s))))
    unwrapped = F.regexp_replace(text, _WRAP, " ")
    both = F.transform(F.array(F.struct(known(_sentences(unwrapped)).alias("a"), known(_sentences(text)).alias("b"))), lambda x: F.concat(x["a"], F.filter(x["b"], lambda i: ~F.array_contains(x["a"], i))))
    return F.when(text.rlike(TRIGGER), both[0]).otherwise(F.array().cast("array<string>"))


def _rule(ids: list[str]) -> tuple[str, str]:
    """A pattern for *ids* in this order, others between them, and what replaces it: the others.

    Each gap ends at the first place of the next identifier and never gives way,
    so a sequence of any length is read once; \\G goes on behind the last match.
    """
    return r"\G" + "".join(rf"((?:(?!{i} )\S+ )*+){i} " for i in ids), "".join(f"${n}" for n in range(1, len(ids) + 1))


def licences(ids: Column) -> Column:
    """The licences of an identifier sequence, each once, in the order of the rules; then what is told by single identifiers that are left."""
    fields = ("name", "need", "rest", "first", "last")
    rules = F.array(*(F.struct(*(F.lit(x).alias(f) for f, x in zip(fields, (name, *_rule(need), need[0], need[-1])))) for name, need in RULES))
    # only rules whose ends are there are tried
    rules = F.filter(rules, lambda r: F.array_contains(ids, r["first"]) & F.array_contains(ids, r["last"]))
    none = F.array().cast("array<string>")
    start = F.struct(F.concat(F.array_join(ids, " "), F.lit(" ")).alias("left"), none.alias("found"))
    telling = _map(TELLING)

    def apply(state: Column, rule: Column) -> Column:
        hit = F.rlike(state["left"], rule["need"])
        return F.struct(F.when(hit, F.regexp_replace(state["left"], rule["need"], rule["rest"])).otherwise(state["left"]).alias("left"), F.when(hit, F.array_append(state["found"], rule["name"])).otherwise(state["found"]).alias("found"))

    def end(state: Column) -> Column:
        return F.concat(state["found"], F.array_compact(F.transform(F.split(state["left"], " "), lambda i: F.try_element_at(telling, i))))

    return F.when(F.size(ids) > 0, F.array_distinct(F.aggregate(rules, start, apply, end))).otherwise(none)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of *docs*: doc_id, sentence_ids, licenses (arrays of strings, empty where none is found).

    A null or empty text has none; repeated rows give a row each; an empty table
    gives none; other columns are not read.
    """
    ids = docs.select(F.col(id_col).alias("doc_id"), sentence_ids(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("sentence_ids"))
    return ids.select("doc_id", "sentence_ids", licences(F.col("sentence_ids")).alias("licenses"))
