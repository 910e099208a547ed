"""Licence scans over published texts, as they are wrapped, indented and commented in practice."""

import textwrap

import pytest
from pyspark.sql import functions as F

from quantloom.llm import licences

MIT = """MIT License

Copyright (c) 2024 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
APACHE = """Copyright 2020 Some Body

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL = """This file is part of Some Tool.

Some Tool is free software{mark} you can redistribute it and/or modify
it under the terms of the GNU {kind}General Public License as published by
the Free Software Foundation{cut} {version}.

Some Tool is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {kind}General Public License for more details.

You should have received a copy of the GNU {kind}General Public License
along with Some Tool. If not, see <https://www.gnu.org/licenses/>."""
BSD = """Copyright (c) 2019-2021, The Some Project Developers
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{name}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED."""
NAME = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
ISC = """ISC License

Copyright (c) 2011, Some Body

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means."""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty.  In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented."""


def gpl(kind, version, later=True, old=False):
    number = f"either version {version} of the License, or\n(at your option) any later version" if later else f"version {version} of the License"
    return GPL.format(kind=kind, version=number, mark=";" if old else ":", cut=";" if old else ",")


TEXTS = {
    "MIT": MIT, "Apache-2.0": APACHE, "ISC": ISC, "MPL-2.0": MPL, "Unlicense": UNLICENSE, "Zlib": ZLIB,
    "BSD-3-Clause": BSD.format(name=NAME), "BSD-2-Clause": BSD.format(name=""),
    "GPL-3.0-or-later": gpl("", "3"), "GPL-3.0-only": gpl("", "3", later=False), "GPL-2.0-or-later": gpl("", "2", old=True), "GPL-2.0-only": gpl("", "2", later=False, old=True),
    "LGPL-3.0-or-later": gpl("Lesser ", "3"), "LGPL-2.1-or-later": gpl("Lesser ", "2.1", old=True), "AGPL-3.0-or-later": gpl("Affero ", "3"),
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.\n   (See accompanying file LICENSE_1_0.txt)",
    "EPL-2.0": "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/",
}
DRESSES = {
    "plain": lambda t: t,
    "windows": lambda t: t.replace("\n", "\r\n"),
    "one line a paragraph": lambda t: "\n\n".join(" ".join(p.split()) for p in t.split("\n\n")),
    "narrow": lambda t: "\n\n".join(textwrap.fill(" ".join(p.split()), 40) for p in t.split("\n\n")),
    "block comment": lambda t: "/*\n" + "\n".join(" * " + x for x in t.split("\n")) + "\n */\nint main() {}\n",
    "hash comment": lambda t: "#!/bin/sh\n" + "\n".join(("# " + x).rstrip() for x in t.split("\n")) + "\n\necho\n",
    "slashes": lambda t: "\n".join("// " + x for x in t.split("\n")),
    "typographic": lambda t: t.replace('"AS IS"', "“AS IS”").replace("(c)", "©"),
    "in prose": lambda t: "Some words before it.\n\n" + t + "\n\nSome words after it",
}


def scan(spark, texts):
    rows = list(enumerate(texts))
    return {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("licence", F.lit(1)).repartition(4)).collect()}


def test_published_texts_in_every_dress(spark):
    cases = [(name, dress, put(text)) for name, text in TEXTS.items() for dress, put in DRESSES.items()]
    got = scan(spark, [t for _, _, t in cases])
    assert [(n, d, got[i].licence) for i, (n, d, _) in enumerate(cases) if got[i].licence != n] == []


def test_every_sentence_and_rule_is_reachable(spark):
    filled = lambda s: s.replace("<*>", "Some Body").replace("<year>", "2020")
    cases = [(n, filled(s)) for n, s in licences.SENTENCES]
    got = scan(spark, ["Before.\n" + textwrap.fill(s, 30, initial_indent="# ", subsequent_indent="# ") + "\nAfter" for _, s in cases])
    assert [(n, got[i].sentence_ids) for i, (n, _) in enumerate(cases) if n not in got[i].sentence_ids.split(",")] == []
    sentence = {}
    for n, s in licences.SENTENCES:
        sentence.setdefault(n, filled(s))
    rules = [(name, seq) for name, seq in licences.RULES if seq]
    got = scan(spark, ["\n\n".join(sentence[x] for x in seq) for _, seq in rules])
    assert [(name, seq, got[i].licences) for i, (name, seq) in enumerate(rules) if name not in got[i].licences.split(",")] == []


NOTICES = {
    "This project is licensed under the MIT License - see the LICENSE file for details.": "MIT",
    "This project is licensed under the MIT License \u2013 see [LICENSE](LICENSE) for details.": "MIT",
    "This software is released under the terms of the MIT license.": "MIT",
    "/*! tool v1.2.3 | (c) Some Body | Released under the MIT license */": "MIT",
    "Licensed under the MIT License (see LICENSE)": "MIT",
    "Licensed under either of Apache License, Version 2.0 or MIT license": "Apache-2.0,MIT",
    "Licensed under either of\n\n * Apache License, Version 2.0\n   (LICENSE-APACHE or http://www.apache.org/licenses/LICENSE-2.0)\n * MIT license\n   (LICENSE-MIT)\n\nat your option.": "Apache-2.0,MIT",
    "Licensed under the Apache License, Version 2.0 <LICENSE-APACHE or https://www.apache.org/licenses/LICENSE-2.0>": "Apache-2.0",
    gpl("", "2", old=True).replace("version 2 of the License,", "version 2,"): "GPL-2.0-or-later",
    gpl("Library ", "2", old=True): "LGPL-2.0-or-later",
    'The contents of this file are subject to the Mozilla Public License Version\n1.1 (the "License"); you may not use this file except in compliance with\nthe License.': "MPL-1.1",
    "Copyright (c) 2020 Some Body. All rights reserved.": "Proprietary",
    "Copyright 2020 " + "Name " * 40 + "\nAll rights reserved": "Proprietary",
    TEXTS["BSD-3-Clause"]: "BSD-3-Clause",
    TEXTS["BSD-2-Clause"]: "BSD-2-Clause",
    TEXTS["BSD-2-Clause"] + "\n\n" + TEXTS["BSD-3-Clause"]: "BSD-2-Clause,BSD-3-Clause",
    TEXTS["BSD-3-Clause"] + "\n\n" + TEXTS["BSD-3-Clause"]: "BSD-3-Clause",
    TEXTS["BSD-3-Clause"] + "\n\n" + MIT: "BSD-3-Clause,MIT",
}


def test_all_licences_of_notices_and_contained_rules(spark):
    got = scan(spark, list(NOTICES))
    assert [(t, got[i].licences) for i, (t, want) in enumerate(NOTICES.items()) if got[i].licences != want] == []


def test_twin_agrees_on_texts_and_notices(spark):
    import duckdb
    import pyarrow as pa

    texts = [*NOTICES, *(put(t) for t in TEXTS.values() for put in DRESSES.values()), None, ""]
    got = {i: (r.licence, r.licences, r.n_sentences, r.sentence_ids) for i, r in scan(spark, texts).items()}
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": list(range(len(texts))), "text": pa.array(texts, pa.string())}))
    from quantloom.llm.licence_sql import oracle

    want = {r[0]: r[1:] for r in con.execute(oracle()).fetchall()}
    assert [(texts[i], got[i], want[i]) for i in want if got[i] != want[i]] == [] and len(want) == len(texts)


def test_tags(spark):
    texts = ["// SPDX-License-Identifier: MIT", "# SPDX-License-Identifier: (MIT OR Apache-2.0) -->", "/* SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 */", "no SPDX-License-Identifier here", "SPDX-License-Identifier: MIT see below\n" + APACHE]
    got = scan(spark, texts)
    assert [(got[i].licence, got[i].licences) for i in range(5)] == [("MIT", "MIT"), ("MIT", "Apache-2.0,MIT"), ("GPL-2.0-only", "Classpath-exception-2.0,GPL-2.0-only"), (None, ""), ("MIT", "Apache-2.0,MIT")]


@pytest.mark.parametrize("text", ["not released under the mit license at all", "Permission is hereby granted.", "licensed under the apache license, version 2.01", "MIT licenses", "x" * 100_000, "a " * 50_000, "\n" * 1000 + ": ; " * 1000, "1. a) " * 500])
def test_other_texts_have_no_licence(spark, text):
    assert scan(spark, [text])[0].licence is None


def test_empty_table(spark):
    assert licences.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
