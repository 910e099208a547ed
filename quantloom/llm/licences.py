"""License scans by sentence rules.

A text is normalised to words with two kinds of marks: hard ones where a
sentence must end (a full stop, a line without words) and soft ones where it
may (a line end, a colon, a semicolon, a list number, a dash or bar between
words, an opening bracket).  A known sentence is
recognised if it starts and ends at marks; soft marks inside it do not matter,
so wrapped, indented and commented licence texts read like plain ones.  The
sequence of a text's sentence identifiers is matched against ordered rules.
All of it is column functions on one row, so nothing is shuffled, joined or
broadcast.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

# Sentences of published licences and notices, as they are written there, and their identifiers.
# <*> stands for up to sixty words, <year> for a year; both stay within one sentence.
SENTENCES = (
    ("MitTitle", "MIT License"),
    ("MitTitle", "The MIT License"),
    ("MitTitle", "The MIT License (MIT)"),
    ("MitRelease", "Released under the MIT License"),
    ("MitRelease", "Licensed under the MIT License"),
    ("MitRelease", "This project is licensed under the MIT License"),
    ("MitRelease", "Distributed under the MIT License"),
    ("MitRelease", "Released under the terms of the MIT License"),
    ("MitRelease", "Licensed under the terms of the MIT License"),
    ("MitRelease", "This project is released under the MIT License"),
    ("MitRelease", "This software is licensed under the MIT License"),
    ("MitRelease", "This software is released under the MIT License"),
    ("MitRelease", "This software is released under the terms of the MIT License"),
    ("EitherOf", "Licensed under either of"),
    ("DualApacheMit", "Licensed under either of Apache License, Version 2.0 or MIT license"),
    ("DualApacheMit", "Licensed under either of Apache License, Version 2.0 or MIT license at your option."),
    ("MitGrant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MitNotice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MitNotice", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software."),
    ("MitWarranty", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("IscTitle", "ISC License"),
    ("IscTitle", "The ISC License"),
    ("IscGrant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("IscGrant", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ZeroBsdGrant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("IscWarranty", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    ("ApacheTitle", "Apache License"),
    ("ApacheVersion2", "Version 2.0, January 2004"),
    ("ApacheTitle2", "Apache License Version 2.0, January 2004"),
    ("ApacheConditions", "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("ApacheRef2", "Licensed under the Apache License, Version 2.0"),
    ("ApacheRef2", 'Licensed under the Apache License, Version 2.0 (the "License")'),
    ("ApacheRef2", "Released under the Apache License, Version 2.0"),
    ("ApacheRef2", "This project is licensed under the Apache License, Version 2.0"),
    ("ApacheRef2", "Licensed under the Apache License 2.0"),
    ("ApacheRef2", "This project is licensed under the Apache License 2.0"),
    ("ApacheName2", "Apache License, Version 2.0"),
    ("ApacheUse", "you may not use this file except in compliance with the License."),
    ("ApacheUse", "You may not use this file except in compliance with the License"),
    ("ApacheCopy", "You may obtain a copy of the License at"),
    ("ApacheWarranty", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("ApacheTerms", "See the License for the specific language governing permissions and limitations under the License."),
    ("GplTitle", "GNU GENERAL PUBLIC LICENSE"),
    ("LgplTitle", "GNU LESSER GENERAL PUBLIC LICENSE"),
    ("LibraryTitle", "GNU LIBRARY GENERAL PUBLIC LICENSE"),
    ("AgplTitle", "GNU AFFERO GENERAL PUBLIC LICENSE"),
    ("Version3June2007", "Version 3, 29 June 2007"),
    ("Version3Nov2007", "Version 3, 19 November 2007"),
    ("Version2June1991", "Version 2, June 1991"),
    ("Version21Feb1999", "Version 2.1, February 1999"),
    ("GplRef3", "This work is licensed under the GNU General Public License, version 3"),
    ("GplRef3", "Licensed under the GNU General Public License, version 3"),
    ("GplRef3", "Released under the GNU General Public License, version 3"),
    ("GplRef2", "This work is licensed under the GNU General Public License, version 2"),
    ("GplRef2", "Licensed under the GNU General Public License, version 2"),
    ("GplRef2", "Released under the GNU General Public License, version 2"),
    ("GplLater3", "<*> is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GplLater3", "<*> is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3, or (at your option) any later version."),
    ("GplOnly3", "<*> is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License."),
    ("GplOnly3", "<*> is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3."),
    ("GplOnly3", "<*> is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation."),
    ("GplLater2", "<*> is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GplLater2", "<*> is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2, or (at your option) any later version."),
    ("GplOnly2", "<*> is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License."),
    ("GplOnly2", "<*> is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2."),
    ("GplOnly2", "<*> is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("LgplLater3", "<*> is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LgplOnly3", "<*> is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, version 3 of the License."),
    ("LibraryLater2", "<*> is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LibraryLater2", "<*> is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2, or (at your option) any later version."),
    ("LgplLater21", "<*> is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LgplOnly21", "<*> is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; version 2.1 of the License."),
    ("AgplLater3", "<*> is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AgplOnly3", "<*> is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3 of the License."),
    ("GnuWarranty", "<*> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("GnuDetails", "See the GNU <*> Public License for more details."),
    ("GnuReceived", "You should have received a copy of the GNU <*> Public License along with <*>"),
    ("BsdTitle3", "BSD 3-Clause License"),
    ("BsdTitle2", "BSD 2-Clause License"),
    ("BsdGrant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BsdSource", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BsdBinary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BsdName", "Neither the name of <*> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BsdName", "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BsdAdvert", "All advertising materials mentioning features or use of this software must display the following acknowledgement:"),
    ("BsdWarranty", 'THIS SOFTWARE IS PROVIDED BY <*> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("MplRef2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MplRef2", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("MplCopy", "If a copy of the MPL was not distributed with this file, You can obtain one at <*>"),
    ("MplRef11", 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License")'),
    ("MplTitle11", "Mozilla Public License Version 1.1"),
    ("MplTitle2", "Mozilla Public License Version 2.0"),
    ("UnlicenseGrant", "This is free and unencumbered software released into the public domain."),
    ("UnlicenseUse", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("BoostTitle", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("BoostRef", "Distributed under the Boost Software License, Version 1.0."),
    ("ZlibWarranty", "This software is provided 'as-is', without any express or implied warranty."),
    ("ZlibGrant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("EplRef2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 <*>"),
    ("EplRef2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 <*>"),
    ("EplRef1", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 <*>"),
    ("CcBy4", "Licensed under CC BY 4.0"),
    ("CcBySa4", "Licensed under CC BY-SA 4.0"),
    ("CcByNc4", "Licensed under CC BY-NC 4.0"),
    ("CcByNd4", "Licensed under CC BY-ND 4.0"),
    ("CcByNcSa4", "Licensed under CC BY-NC-SA 4.0"),
    ("CcByNcNd4", "Licensed under CC BY-NC-ND 4.0"),
    ("CcBy4", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CcBySa4", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CcByNc4", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("Cc0", "Licensed under CC0 1.0"),
    ("Cc0", "CC0 1.0 Universal"),
    ("Copyright", "Copyright <*> <year> <*>"),
    ("Rights", "All rights reserved"),
)

# Ordered rules; the identifiers must follow each other in this order, others may stand between.
RULES = (
    ("Apache-2.0", ("ApacheRef2", "ApacheUse", "ApacheWarranty", "ApacheTerms")),
    ("Apache-2.0", ("ApacheTitle", "ApacheVersion2", "ApacheConditions")),
    ("Apache-2.0", ("ApacheTitle2", "ApacheConditions")),
    ("Apache-2.0", ("ApacheRef2",)),
    ("Apache-2.0", ("DualApacheMit",)),
    ("Apache-2.0", ("EitherOf", "ApacheName2")),
    ("MIT", ("MitGrant", "MitNotice", "MitWarranty")),
    ("MIT", ("MitRelease",)),
    ("MIT", ("DualApacheMit",)),
    ("MIT", ("EitherOf", "MitTitle")),
    ("MIT", ("MitTitle", "MitGrant")),
    ("MIT", ("MitTitle", "Copyright")),
    ("ISC", ("IscGrant", "IscWarranty")),
    ("ISC", ("IscGrant",)),
    ("0BSD", ("ZeroBsdGrant",)),
    ("AGPL-3.0-or-later", ("AgplLater3",)),
    ("AGPL-3.0-only", ("AgplOnly3",)),
    ("AGPL-3.0-only", ("AgplTitle", "Version3Nov2007")),
    ("LGPL-3.0-or-later", ("LgplLater3",)),
    ("LGPL-3.0-only", ("LgplOnly3",)),
    ("LGPL-3.0-only", ("LgplTitle", "Version3June2007")),
    ("LGPL-2.0-or-later", ("LibraryLater2",)),
    ("LGPL-2.0-only", ("LibraryTitle", "Version2June1991")),
    ("LGPL-2.1-or-later", ("LgplLater21",)),
    ("LGPL-2.1-only", ("LgplOnly21",)),
    ("LGPL-2.1-only", ("LgplTitle", "Version21Feb1999")),
    ("GPL-3.0-or-later", ("GplLater3",)),
    ("GPL-3.0-only", ("GplOnly3",)),
    ("GPL-3.0-only", ("GplRef3",)),
    ("GPL-3.0-only", ("GplTitle", "Version3June2007")),
    ("GPL-2.0-or-later", ("GplLater2",)),
    ("GPL-2.0-only", ("GplOnly2",)),
    ("GPL-2.0-only", ("GplRef2",)),
    ("GPL-2.0-only", ("GplTitle", "Version2June1991")),
    ("BSD-4-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdAdvert", "BsdName")),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdName")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary")),
    ("MPL-2.0", ("MplRef2",)),
    ("MPL-2.0", ("MplTitle2",)),
    ("MPL-1.1", ("MplRef11",)),
    ("MPL-1.1", ("MplTitle11",)),
    ("Unlicense", ("UnlicenseGrant", "UnlicenseUse")),
    ("BSL-1.0", ("BoostTitle",)),
    ("BSL-1.0", ("BoostRef",)),
    ("Zlib", ("ZlibWarranty", "ZlibGrant")),
    ("EPL-2.0", ("EplRef2",)),
    ("EPL-1.0", ("EplRef1",)),
    ("CC-BY-NC-SA-4.0", ("CcByNcSa4",)),
    ("CC-BY-NC-ND-4.0", ("CcByNcNd4",)),
    ("CC-BY-NC-4.0", ("CcByNc4",)),
    ("CC-BY-SA-4.0", ("CcBySa4",)),
    ("CC-BY-ND-4.0", ("CcByNd4",)),
    ("CC-BY-4.0", ("CcBy4",)),
    ("CC0-1.0", ("Cc0",)),
    ("Proprietary", ("Copyright", "Rights")),
    ("UnmatchedLicence", ()),
)

#: Rules that only count where no other one holds.
ALONE = ("Proprietary",)

#: What is no word: ASCII other than letters and digits.
NO_WORD = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
# The steps of the normalisation, in order: pattern and replacement.
STEPS = (
    (r"([^ \t\n])[ \t]+[-|\x{2012}-\x{2015}][ \t]+([^ \t\n])", "$1 ; $2"),
    (r"([^ \t\n])[ \t]+[(<]", "$1 ; "),
    (r"[/|\xA0\xAB\xBB\x{2010}-\x{2027}]", " "),
    (r"\xA9", " c "),
    (r"\r\n?", "\n"),
    (r"v\.(?<![0-9a-z]v\.)[ \n]", "v "),
    (rf"(^|[\n:;])([{NO_WORD}&&[^\n:;]]*)([0-9]{{1,2}}|[a-z]|[ivx]{{2,4}})[.)][ \t]", "$1$2 $3 ; "),
    (r"[.!?]+[\x22')\]*]*(\s|$)", " | $1"),
    (rf"\n(?:[{NO_WORD}&&[^\n|]]*\n)+", " | "),
    (r"[\n:;]", " / "),
    (rf"[{NO_WORD}&&[^/|]]+", " "),
    (r"(?:/ )+", "/ "),
)
# A licence tag names its licence itself, or several with operators.
TAG_NAME = r"[A-Za-z0-9][A-Za-z0-9.+-]*"
TAG = rf"(?:SPDX|spdx)-[Ll]icense-[Ii]dentifier:[ \t]*(\(*{TAG_NAME}\)*(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(*{TAG_NAME}\)*)*)"


def clues(known) -> list[str]:
    """Parts of words of which every known sentence has one: a text without any of them has no known sentence."""
    left, out = [plain_words(s) for _, s in known], []
    while left:
        has = Counter(w for words in left for w in {w for w in words if len(w) >= 7})
        best = min(has, key=lambda w: (-has[w], w))
        out.append(best)
        left = [words for words in left if not any(best in w for w in words)]
    return out


def marked(text: Column) -> Column:
    """A lower-cased text as words between marks: ``| w w / w | w |``."""
    out = text
    for pattern, by in STEPS:
        out = F.regexp_replace(out, pattern, by)
    return F.concat(F.lit("| "), F.trim(out), F.lit(" |"))


def plain_words(sentence: str) -> list[str]:
    """A table sentence's words; slots stay as they are."""
    text = re.sub(r"\bv\. ", "v ", sentence.lower().replace("/", " "))
    return re.findall(r"<\*>|<year>|[0-9a-z]+", text)


_GAP = r" (?:/ )?"
_SLOT = r"[^ |]+(?: [^ |]+){0,59}?"
_YEAR = r"(?:19|20)[0-9][0-9]"


def sentence_pattern(sentence: str, gap: str = _GAP) -> str:
    """Pattern of a table sentence without a slot at its start; a slot takes its gap with it and may be empty."""
    words = plain_words(sentence.removeprefix("<*>"))
    last = len(words) - 1
    out = words[0]
    for i, w in enumerate(words[1:], 1):
        out += {"<*>": f"(?: {_SLOT})?" if i == last else f"(?:{gap}{_SLOT})?", "<year>": gap + _YEAR}.get(w, gap + w)
    return out


def _alternation(known) -> str:
    """One pattern: by first word, longest first; sentences with a slot at the start share it."""
    heads: dict[str, list[str]] = {}
    for _, s in known:
        heads.setdefault(plain_words(s)[0], []).append(sentence_pattern(s))
    grouped = {h: "(?:" + "|".join(sorted(own, key=len, reverse=True)) + ")" for h, own in heads.items()}
    free = grouped.pop("<*>", None)
    return "|".join([*grouped.values(), *([f"(?:{_SLOT} )?{free}"] if free else [])])


def recognised(text: Column, known=SENTENCES) -> Column:
    """The known sentences of a text in order, without soft marks; of those that start at one mark the longest."""
    some = lambda low: reduce(lambda a, b: a | b, [low.contains(c) for c in clues(known)])
    text = F.get(F.transform(F.array(ascii_lower(F.coalesce(text, F.lit("")))), lambda low: F.when(some(low), low)), F.lit(0))  # lower-cased once
    found = F.regexp_extract_all(F.when(text.isNotNull(), marked(text)).otherwise(""), F.lit(rf"(?<=[|/] )(?:{_alternation(known)})(?= [|/])"), F.lit(0))
    return F.transform(found, lambda s: F.regexp_replace(s, " / ", " "))


def identifiers(text: Column, known=SENTENCES) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    fixed = {" ".join(plain_words(s)): n for n, s in known if "<" not in s}
    free = [(n, s) for n, s in known if "<" in s]
    table = F.create_map(*[F.lit(x) for pair in fixed.items() for x in pair])
    name = lambda s: F.coalesce(F.try_element_at(table, s), *[F.when(s.rlike(f"{'' if p.startswith('<*>') else '^'}{sentence_pattern(p, ' ')}$"), F.lit(n)) for n, p in free])
    return F.filter(F.transform(recognised(text, known), name), lambda x: x.isNotNull())


def tagged(text: Column) -> Column:
    """Names in the licence tags of a text, in order; operators of their expressions are left out."""
    lines = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TAG), F.lit(1))
    names = F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(TAG_NAME), F.lit(0))))
    return F.filter(names, lambda x: ~F.upper(x).isin("AND", "OR", "WITH"))


def rule_pattern(seq: tuple[str, ...]) -> str:
    return " " + " (?:.* )?".join(seq) + " "


def _line(ids: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(ids, " "), F.lit(" "))


def licence_of(ids: Column, tags: Column, rules=RULES) -> Column:
    """The first tag; without one, the first rule whose identifiers occur in their order; null without either."""
    out = F.when(F.size(tags) > 0, F.get(tags, F.lit(0))).when(F.size(ids) == 0, F.lit(None).cast("string"))
    for name, seq in rules:
        out = out.when(_line(ids).rlike(rule_pattern(seq)) if seq else F.lit(True), F.lit(name))
    return out


def longer(seq: tuple[str, ...], name: str, rules=RULES) -> list[tuple[str, ...]]:
    """Sequences of other licences that have all of ``seq`` in its order and more, the longest first."""

    def has(own: tuple[str, ...]) -> bool:
        left = iter(own)
        return all(x in left for x in seq)

    found = {own for other, own in rules if other != name and len(own) > len(seq) and has(own)}
    return sorted(found, key=lambda own: (-len(own), own))


def without_pattern(seq: tuple[str, ...]) -> tuple[str, str]:
    """Pattern and replacement that take a sequence out of a line and leave what stands between."""
    return " " + " (.*? )??".join(seq) + " ", " " + "".join(f"${i}" for i in range(1, len(seq)))


def licences_of(ids: Column, tags: Column, rules=RULES) -> Column:
    """Names of all tags and of all rules that hold, sorted.

    Sentences that a longer rule uses do not count for a rule that it
    contains; a rule of ALONE counts only where no other does.
    """

    def held(name: str, seq: tuple[str, ...]) -> Column:
        line = _line(ids)
        for own in longer(seq, name, rules):
            pattern, left = without_pattern(own)
            line = F.regexp_replace(line, pattern, left)
        return F.when(line.rlike(rule_pattern(seq)), F.lit(name))

    some = lambda alone: F.filter(F.array(*[held(name, seq) for name, seq in rules if seq and (name in ALONE) == alone]), lambda x: x.isNotNull())
    named = F.concat(tags, some(False))
    return F.array_sort(F.array_distinct(F.when(F.size(named) > 0, named).otherwise(some(True))))


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, licence, licences (of all tags and rules that hold), n_sentences, sentence_ids.

    The licence is null if no licence sentence is known and there is no tag;
    known sentences that fit no rule give ``UnmatchedLicence``.  Null and empty
    texts have no sentences.  Rows are judged one by one, so repeated rows
    repeat their result; an empty table gives an empty one.  Other columns are
    ignored.
    """
    found = docs.select(F.col(doc_id).alias("__id"), identifiers(F.col(text)).alias("__ids"), tagged(F.col(text)).alias("__tags"))
    return found.select(
        F.col("__id").alias(doc_id), licence_of(F.col("__ids"), F.col("__tags")).alias("licence"), F.array_join(licences_of(F.col("__ids"), F.col("__tags")), ",").alias("licences"),
        F.size("__ids").cast("long").alias("n_sentences"), F.array_join("__ids", ",").alias("sentence_ids"),
    )
