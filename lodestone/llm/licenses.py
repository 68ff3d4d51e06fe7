"""Licence scans: sparse TF-IDF cosine to templates, then inheritance down directory paths.

A text is cut into lines and sentences, and each of them, whatever words it has,
is a sparse vector over the templates' vocabulary; the rest of its words only
make it longer. Those that an upper bound of the cosine doesn't rule out meet
the templates through an inverted index, and grow by the sentences after them as
long as that brings them closer. The closest template above the threshold names
the licence; a version that is stated counts before the template's. A file that
states none inherits that of the licence file in the nearest directory above it.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import compress, groupby, pairwise
from operator import and_, not_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, releasing

TERM = re.compile(r"[a-z0-9][a-z0-9.+-]*[a-z0-9+]|[a-z0-9]")
#: Where a sentence ends and another begins.
SENTENCE = re.compile(r"(?<=[.!?])[ \t]+(?=[A-Z(\[\"'])")
#: An exact name of a licence, or an expression of such names.
SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*\(?([A-Za-z0-9.+-]+(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(?[A-Za-z0-9.+-]+\)?)*)")
#: What says that a licence is not the one of this work.
NEGATED = re.compile(r"\b(?:not|never|neither|no longer|n't)\b(?:\s+\w+){0,3}?\s+(?:released|licen[cs]ed|distributed|available|covered|published|provided|under)\b", re.I)
#: What states terms of a work, even if no template matches: a licence that is spoken of in general doesn't.
STATES = re.compile(
    r"SPDX-License-Identifier|all rights reserved|(?:\(c\)|copyright|\u00a9)\s*(?:\(c\)|\u00a9|by\b)?\s*(?:19|20)\d\d|public domain|(?:licen[cs]ed|released|distributed|made available|published|redistributed)\s+under|"
    r"(?:under|subject to|accept|with) the (?:terms|conditions) of|permission (?:is|to use)|(?:this|the|its|our|following) licen[cs]e (?:of|for|covers|applies|governs|agreement|terms|grants)|licen[cs]e agreement|see (?:the )?(?:file )?(?:LICEN[CS]E|COPYING)\b",
    re.I,
)
#: Every match of ``STATES`` has one of these, in lower case.
MAY_STATE = ("licen", "copyright", "(c)", "\u00a9", "rights reserved", "public domain", "under", "permission", "terms", "conditions")
#: Licences that come in versions: how a statement names the family, and what the names of others in it rule out.
FAMILIES = {
    "AGPL": (r"affero general public licen[cs]e|\bagpl", None),
    "LGPL": (r"(?:lesser|library) general public licen[cs]e|\blgpl", None),
    "GPL": (r"general public licen[cs]e|\bgpl", "affero|lesser|library|agpl|lgpl"),
    "Apache": (r"apache (?:software )?licen[cs]e|licenses/license", None),
    "MPL": (r"mozilla public licen[cs]e|\bmpl\b", None),
    "EPL": (r"eclipse public licen[cs]e|\bepl\b", None),
    "CC-BY-NC": (r"attribution[ -]non-?commercial|\bcc[ -]by[ -]nc\b", r"share-?alike|by[ -]nc[ -](?:sa|nd)|no-?deriv"),
    "CC-BY-SA": (r"attribution[ -]share-?alike|\bcc[ -]by[ -]sa\b", r"non-?commercial|by[ -]nc"),
    "CC-BY": (r"creative commons attribution|\bcc[ -]by\b", r"share-?alike|non-?commercial|no-?deriv|by[ -](?:sa|nc|nd)"),
}
_NAMED = {f: (re.compile(names, re.I), re.compile(others, re.I) if others else None, re.compile(rf"(?:{names})[^0-9]{{0,120}}?(\d+(?:\.\d+)?)", re.I | re.S)) for f, (names, others) in FAMILIES.items()}
#: What a text says that reserves all rights and grants none; any licence beside it counts first.
RESERVED = "LicenseRef-All-Rights-Reserved"
#: Phrases that name licences, as short headers state them (fixed list).
TEMPLATES = {
    RESERVED: ["All rights reserved.", "Copyright. All rights reserved."],
    "GPL-2.0": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2"],
    "AGPL-3.0": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3"],
    "LGPL-2.1": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", "This library is licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"],
    "ISC": ["ISC License", "Licensed under the ISC License.", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "CC0-1.0": ["CC0 1.0 Universal", "Released under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."],
    "Unlicense": ["Released under the Unlicense.", "SPDX-License-Identifier: Unlicense", "This is free and unencumbered software released into the public domain."],
    "Apache-2.0": ["Apache License Version 2.0, January 2004", "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "MIT": ["The MIT License (MIT)", "Released under the MIT License.", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND"],
    "BSD-3-Clause": ["BSD 3-Clause License", "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"],
    "GPL-3.0": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3"],
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "This library is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "Apache-1.1": ["The Apache Software License, Version 1.1", "SPDX-License-Identifier: Apache-1.1"],
    "MPL-1.1": ["Mozilla Public License Version 1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License", "SPDX-License-Identifier: MPL-1.1"],
    "EPL-2.0": ["Eclipse Public License - v 2.0", "SPDX-License-Identifier: EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "Zlib": ["zlib License", "SPDX-License-Identifier: Zlib", "This software is provided 'as-is', without any express or implied warranty. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"],
    "BSL-1.0": ["Boost Software License - Version 1.0", "SPDX-License-Identifier: BSL-1.0", "Distributed under the Boost Software License, Version 1.0."],
    "MPL-2.0": ["Mozilla Public License Version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International", "Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International", "Licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International", "Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
}
NAMES = "path string, license_found string, cosine double, is_license_file boolean, states boolean"


def terms(text: str) -> list[str]:
    """Words and pairs of neighbours."""
    found = TERM.findall(text.lower())
    return found + [f"{a} {b}" for a, b in zip(found, found[1:], strict=False)]


class Templates:
    """TF-IDF vectors of the templates, of length one; the idf is that of the templates."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES) -> None:
        rows = [(name, Counter(terms(t))) for name in sorted(templates) for t in templates[name]]
        df = Counter(w for _, c in rows for w in c)
        self.names, self.known = [name for name, _ in rows], set(templates)
        self.idf = {w: np.log((1 + len(rows)) / (1 + n)) + 1 for w, n in df.items()}
        self.postings: dict[str, list[tuple[int, float]]] = {}
        for i, (_, c) in enumerate(rows):
            norm = np.sqrt(sum((n * self.idf[w]) ** 2 for w, n in c.items()))
            for w, n in c.items():
                self.postings.setdefault(w, []).append((i, n * self.idf[w] / norm))
        self.idf = {w: float(x) for w, x in self.idf.items()}
        self.peak = {w: float(max(y for _, y in ps)) for w, ps in self.postings.items()}
        self.unknown = float(np.log(1 + len(rows)) + 1)
        self.squares = {w: float(x * x) for w, x in self.idf.items() if " " not in w}

    def bound(self, words: list[str]) -> float:
        """What the cosine of a statement of these words can be at most: as if one template had the greatest weight of all for each of its words and pairs."""
        known = [w in self.squares for w in words]
        if not any(known):
            return 0.0
        found = list(Counter(compress(words, known)).items())
        pairs = Counter([f"{words[i]} {words[i + 1]}" for i in compress(range(len(words)), map(and_, known, known[1:]))])
        found += [(w, n) for w, n in pairs.items() if w in self.idf]
        # every other word and every other pair of neighbours lies outside, once at least
        outside = len(set(compress(words, map(not_, known)))) + len(set(pairwise(words))) - sum([w in self.idf for w in pairs])
        dot = inside = 0.0
        for w, n in found:
            x = n * self.idf[w]
            inside += x * x
            dot += x * self.peak[w]
        return dot / (inside + self.unknown**2 * outside) ** 0.5

    def closest(self, statement: str) -> tuple[str | None, float]:
        c = Counter(terms(statement))
        scores, norm = np.zeros(len(self.names)), 0.0
        for w, n in c.items():
            x = n * self.idf.get(w, self.unknown)
            norm += x * x
            for i, y in self.postings.get(w, ()):
                scores[i] += x * y
        if not norm:
            return None, 0.0
        best = int(scores.argmax())
        return self.names[best], float(scores[best] / np.sqrt(norm))

    def named(self, statement: str) -> tuple[str | None, float]:
        """The licence that a statement names: an exact name, else the closest template's family in the version that is stated. Null if it is negated."""
        exact = SPDX.search(statement)
        if exact:
            name = exact[1]
            return (name.removesuffix("-only") if name.removesuffix("-only") in self.known else name), 1.0
        name, cosine = self.closest(statement)
        if name is None or NEGATED.search(statement):
            return None, 0.0 if name is None else cosine
        for family, (names, others, versioned) in _NAMED.items():
            if names.search(statement) and not (others and others.search(statement)):
                if name != RESERVED and not name.startswith(tuple(f"{f}-" for f in _NAMED)):
                    break  # a licence without versions is closer: the family is only spoken of
                stated = versioned.search(statement)
                if stated:
                    return f"{family}-{stated[1] if '.' in stated[1] else stated[1] + '.0'}", cosine
                if name.rsplit("-", 1)[0] != family:
                    name = next((n for n in sorted(self.known, reverse=True) if n.rsplit("-", 1)[0] == family), name)
                break
        return name, cosine


def states_terms(text: str) -> bool:
    """Whether terms of the work are stated, in whatever words."""
    low = text.lower()
    return any(k in low for k in MAY_STATE) and bool(STATES.search(NEGATED.sub(" ", text)))


def units(text: str) -> list[tuple[int, int]]:
    """Where the sentences of each line begin and end."""
    out, at = [], 0
    for line in text.split("\n"):
        end = at + len(line)
        for cut in SENTENCE.finditer(line) if line else ():
            out.append((at, end - len(line) + cut.start()))
            at = end - len(line) + cut.end()
        if at < end:
            out.append((at, end))
        at = end + 1
    return out


def statements(text: str, model: Templates, whole: bool = False, least: float = 0.25) -> list[tuple[str, int, str | None, float]]:
    """What may state a licence: ``(statement, its length, name, cosine)``.

    Sentences with an exact name; those whose cosine may reach ``least``, each grown by those after it as
    long as its cosine rises; runs of such sentences; and, if ``whole``, the
    text. Nothing is left out for its length or for the words that it lacks.
    """
    places, out = units(text), []
    held = [model.bound(TERM.findall(text[lo:hi].lower())) >= least for lo, hi in places]
    exact = {k for k, (lo, hi) in enumerate(places) if SPDX.search(text, lo, hi)} if "SPDX-License-Identifier" in text else set()
    out += [text[slice(*places[k])] for k in sorted(exact)]
    after = 0
    for k, (lo, hi) in enumerate(places):
        if not held[k]:
            continue
        best = model.closest(text[lo:hi])[1]
        grows = k >= after  # what another has grown over stands by itself
        after = max(after, k + 1)
        while grows and after < len(places) and (more := model.closest(text[lo : places[after][1]])[1]) > best:
            best, hi, after = more, places[after][1], after + 1
        if best >= least:
            out.append(text[lo:hi])
    for flag, run in groupby(range(len(places)), held.__getitem__):
        ks = list(run)
        if flag and len(ks) > 1:
            out.append(text[places[ks[0]][0] : places[ks[-1]][1]])
    if whole and text:
        out.append(text)
    return [(t, len(t), *model.named(t)) for t in dict.fromkeys(out)]


def scan_licenses(files: DataFrame, path: str = "path", text: str = "text", *, threshold: float = 0.5, file_share: float = 0.3, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """One row for each input row: ``path, license, origin, cosine, inherited_from``.

    ``license`` is the name of the closest template, in the version that the text
    states, or an exact name that stands in it. ``origin`` is ``file`` (a licence
    file: its statement is ``file_share`` of its text or more, or it is named like
    one), ``header``, ``inherited``, ``unknown`` (terms are stated that no template
    matches; nothing is inherited over them) or ``none``. Licences that are denied
    or spoken of in general aren't stated. Of several licence files in a directory the one with the greatest
    cosine counts, then the first path. Null and empty texts state nothing; null
    paths have no directory and inherit nothing. Whole texts are searched, of
    any length. Repeated rows are rows like any other. An empty table gives an
    empty result; further columns, with whatever names, are ignored.
    """
    model = Templates(templates)

    def run(batches):
        for batch in batches:
            out = []
            for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                named = bool(p and re.search(r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$", p))
                found = [x for x in statements(t or "", model, whole=named)]
                granted = [x for x in found if x[2] is not None and x[3] >= threshold]
                granted = [x for x in granted if x[2] != RESERVED] or granted
                _, size, name, cosine = max(granted, key=lambda x: x[3], default=("", 0, None, max((x[3] for x in found if x[2]), default=0.0)))
                size = max((x[1] for x in granted if x[2] == name), default=size)
                # a licence that is denied, or spoken of in general, isn't stated
                states = name is not None or states_terms(t or "")
                out.append((p, name, round(cosine, 6), name is not None and (named or size >= file_share * len(t)), states))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [[]] * 5, (pa.string(), pa.string(), pa.float64(), pa.bool_(), pa.bool_()), strict=True)], names=["path", "license_found", "cosine", "is_license_file", "states"])

    found = materialize(files.select(F.col(path).cast("string").alias("path"), F.col(text).alias("text")).mapInArrow(releasing(run), NAMES), "license-found")
    folder = F.regexp_extract("path", r"^(.*)/", 1)
    owners = found.where("is_license_file and path is not null").select(folder.alias("folder"), "path", "license_found", "cosine")
    owners = owners.groupBy("folder").agg(F.min(F.struct((-F.col("cosine")).alias("c"), F.col("path"), F.col("license_found"))).alias("o")).select("folder", F.col("o.license_found").alias("above"), F.col("o.path").alias("inherited_from"))
    # directories, not files, look for the nearest one above: each once, along its own path
    folders = found.where("license_found is null and path is not null and not states").select(folder.alias("own")).distinct()
    parts = F.split("own", "/")
    ancestors = folders.withColumn("depth", F.explode(F.sequence(F.lit(0), F.size(parts)))).withColumn("folder", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/"))
    nearest = ancestors.join(owners, "folder").groupBy("own").agg(F.max(F.struct("depth", "above", "inherited_from")).alias("n")).select(F.col("own"), F.col("n.above").alias("above"), F.col("n.inherited_from").alias("inherited_from"))
    alone = F.concat(F.lit("\u0000"), F.coalesce("path", F.lit("")))  # no folder is called so, and such keys spread
    look = found.withColumn("own", F.when(F.col("license_found").isNull() & F.col("path").isNotNull() & ~F.col("states"), folder).otherwise(alone))
    joined = look.join(nearest, "own", "left")
    return joined.select(
        "path",
        F.coalesce("license_found", "above").alias("license"),
        F.when(F.col("is_license_file"), "file").when(F.col("license_found").isNotNull(), "header").when(F.col("above").isNotNull(), "inherited").when(F.col("states"), "unknown").otherwise("none").alias("origin"),
        "cosine",
        "inherited_from",
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """``(path, text)`` of documents: a tree of sources, with folders of 10,000 and of 1,000 identifiers."""
    place = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.floor(F.col("doc_id") / 10_000).cast("string"), F.floor(F.col("doc_id") / 1_000).cast("string"), F.col("doc_id").cast("string"))
    return docs.select(F.when(F.col("doc_id").isNotNull(), place).alias("path"), "text")
