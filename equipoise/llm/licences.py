"""License scans: normalised sentences become identifiers of known licence sentences; sequences of these meet ordered rules.

All within one row's expressions: no shuffle, no Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known licence sentences, as the public licences and their customary notices word them.
SENTENCES = {
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-title": "The MIT License (MIT)",
    "mit-title-short": "MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "apache-2": "Licensed under the Apache License, Version 2.0.",
    "apache-2-the": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-2-may-not": "you may not use this file except in compliance with the License.",
    "apache-2-copy": "You may obtain a copy of the License at",
    "apache-2-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-2-see": "See the License for the specific language governing permissions and limitations under the License.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-licensed": "Licensed under the BSD License.",
    "gpl-work-3": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-work-2": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-free-2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-see": "See the GNU General Public License for more details.",
    "lgpl-work-3": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0.",
    "cc-by-4": "Licensed under CC BY 4.0.",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0.",
    "cc-by-long-4": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "lgpl-free-2": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-free-3": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-warranty": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl-see": "See the GNU Lesser General Public License for more details.",
    "agpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-see": "See the GNU Affero General Public License for more details.",
    "epl-2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-event": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "bsl-1": "Distributed under the Boost Software License, Version 1.0.",
    "cc-by-sa-long-4": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-long-4": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nd-long-4": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "all-rights": "All rights reserved.",
}

#: Rules in order; the first whose sentences follow each other takes them.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["mit-title"]), ("MIT", ["mit-title-short"]), ("MIT", ["mit-released"]), ("MIT", ["mit-licensed"]),
    ("Apache-2.0", ["apache-2-the", "apache-2-may-not", "apache-2-copy", "apache-2-as-is", "apache-2-see"]),
    ("Apache-2.0", ["apache-2-the", "apache-2-may-not"]),
    ("Apache-2.0", ["apache-2-the"]), ("Apache-2.0", ["apache-2"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("BSD-1-Clause", ["bsd-redistribution", "bsd-source"]),
    ("BSD", ["bsd-licensed"]),
    ("AGPL-3.0-or-later", ["agpl-free", "gpl-warranty", "agpl-see"]), ("AGPL-3.0-or-later", ["agpl-free"]),
    ("LGPL-3.0-or-later", ["lgpl-free-3", "lgpl-warranty", "lgpl-see"]), ("LGPL-3.0-or-later", ["lgpl-free-3"]),
    ("LGPL-2.1-or-later", ["lgpl-free-2", "lgpl-warranty", "lgpl-see"]), ("LGPL-2.1-or-later", ["lgpl-free-2"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-warranty", "gpl-see"]), ("GPL-3.0-or-later", ["gpl-free", "gpl-warranty"]), ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-2.0-or-later", ["gpl-free-2", "gpl-warranty", "gpl-see"]), ("GPL-2.0-or-later", ["gpl-free-2", "gpl-warranty"]), ("GPL-2.0-or-later", ["gpl-free-2"]),
    ("EPL-2.0", ["epl-2"]), ("Zlib", ["zlib-as-is", "zlib-event", "zlib-grant"]), ("BSL-1.0", ["bsl-1"]), ("0BSD", ["0bsd-grant"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-long-4"]), ("CC-BY-NC-4.0", ["cc-by-nc-long-4"]), ("CC-BY-ND-4.0", ["cc-by-nd-long-4"]),
    ("GPL-3.0-only", ["gpl-work-3"]), ("GPL-2.0-only", ["gpl-work-2"]), ("LGPL-3.0-only", ["lgpl-work-3"]),
    ("MPL-2.0", ["mpl-2", "mpl-2-copy"]), ("MPL-2.0", ["mpl-2"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]), ("CC-BY-SA-4.0", ["cc-by-sa-4"]), ("CC-BY-4.0", ["cc-by-4"]), ("CC-BY-4.0", ["cc-by-long-4"]),
    ("CC0-1.0", ["cc0"]), ("Unlicense", ["unlicense"]), ("ISC", ["isc-grant"]),
]

_END = r"[.!?;:]+(?=\s|$)"

#: In turn: ends of sentences with all around them to E, then line ends with all around them to L, then all else but letters and digits to a space. Lower case leaves E and L free; a run is tried from its start only.
_STEPS = [(_END, "E"), (r"(?<![^a-z0-9])[^a-z0-9E]*+E[^a-z0-9]*+", "E"), (r"(?<![^a-z0-9E])[^a-z0-9E\n]*+\n[^a-z0-9E]*+", "L"), (r"[^a-z0-9EL]+", " ")]


def normal(s: Column) -> Column:
    """A-Z, a-z and 0-9 in lower case, with E, L or a space between words; an E at both ends."""
    s = F.lower(s)
    for found, put in _STEPS:
        s = F.regexp_replace(s, found, put)
    return F.concat(F.lit("E"), F.trim(s), F.lit("E"))


def normal_text(s: str) -> str:
    """The same in Python, for the tables above; without line ends and outer marks."""
    s = s.lower()
    for found, put in _STEPS:
        s = re.sub(found, put, s)
    return s.replace("L", " ").strip(" E")


def hints(normals: Iterable[str], least: int = 6) -> list[str]:
    """Words such that every normalised sentence holds one: those that most sentences share, of `least` letters where a sentence has any so long."""
    open_, out = {t for t in normals if t}, []
    while open_:
        words = {w for t in open_ for w in [x for x in t.split(" ") if len(x) >= least] or [max(t.split(" "), key=len)]}
        best = max(sorted(words), key=lambda w: sum(w in t for t in open_))
        out.append(best)
        open_ = {t for t in open_ if best not in t}
    return out


def scan(docs: DataFrame, sentences: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None, text_col: str = "text") -> DataFrame:
    """docs with sentence_ids array<string>, licences array<string> (distinct, in order of the rules), and unmatched_ids (known sentences that no rule took).

    Sentences end at .!?;: before white space, and begin and end at line ends too; one may run over any
    lines. A known sentence with such a mark inside is found where the text has a mark there too. At a
    place where several fit, the longest is taken. A rule's
    sentences must follow each other (unknown ones between them aside); every place where it fits is
    taken before the next rule. A text is looked at only if it holds one of the words that `hints` takes from the sentences given, without
    which none can be there. "All rights reserved." is known but no licence, so it stays unmatched. Null and empty texts have empty arrays, a
    text counts whole however long it is, repeated rows are scanned alike and all returned, an empty table gives no rows. Columns of `docs` with one of
    the new names give way; others stay.
    """
    sentences, rules = SENTENCES if sentences is None else sentences, RULES if rules is None else rules
    known = {normal_text(t): k for k, t in sentences.items()}
    texts = sorted(known, key=len, reverse=True)
    to_id = F.create_map(*[F.lit(x) for t in texts for x in (t, known[t])])
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    any_known = "(?<=[EL])(?:" + "|".join(t.replace(" ", "[ L]") for t in texts) + ")(?=[EL])"
    found = F.transform(F.regexp_extract_all(normal(text), F.lit(any_known), F.lit(0)), lambda s: F.element_at(to_id, F.translate(s, "L", " ")))
    none = F.array().cast("array<string>")
    new = ("sentence_ids", "licences", "unmatched_ids")
    ids = docs.select(*[docs[c] for c in docs.columns if c not in new], F.when(F.lower(text).rlike("|".join(hints(texts)) or "$^"), found).otherwise(none).alias("sentence_ids"))
    start = F.struct(F.concat(F.lit(" "), F.concat_ws("  ", "sentence_ids"), F.lit(" ")).alias("left"), none.alias("got"))
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(" " + "  ".join(seq) + " ").alias("seq")) for name, seq in rules])
    fold = F.aggregate(
        table, start,
        lambda acc, r: F.struct(F.replace(acc["left"], r["seq"], F.lit(" | ")).alias("left"), F.when(F.contains(acc["left"], r["seq"]), F.array_append(acc["got"], r["name"])).otherwise(acc["got"]).alias("got")),
        lambda acc: F.struct(F.array_distinct(acc["got"]).alias("licences"), F.filter(F.split(acc["left"], r"[ |]+"), lambda s: s != "").alias("unmatched_ids")),
    )
    done = F.when(F.size("sentence_ids") > 0, fold).otherwise(F.struct(none.alias("licences"), none.alias("unmatched_ids")))
    return ids.withColumn("__done", done).select(*ids.columns, "__done.licences", "__done.unmatched_ids")
