"""License scans by conditional compression.

Words round a license's cue words, as many as a match can have, form candidate blocks. Every template is
compressed by zstandard alone and with the block as a raw dictionary, and only one that shrinks by
LEAST_REDUCTION is looked for there: what else a block holds does not count, as it is the template that is
compressed. Its places are then confirmed by their exact wording: the words that they lack or add. A
finding is ``exact`` without differences, ``variant`` with few, and is dropped beyond MOST_DIFFERENT of the
template's words, or if a word that tells licenses apart (a version, a name) differs. It spans the wording
itself, with closing punctuation; its reduction is that of its own characters by the template.

Whole texts are scanned: the cue test runs in the JVM, and only texts with a cue reach Python. Blocks
are cut to windows of WINDOW times the longest match; blocks that many documents share are scored once a
task's cache.

Defined cases: a null text is empty; a null doc_id is kept; repeated rows give one row each; a
document without findings has an empty list; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import difflib
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, text_of

#: What may stand between the words of a cue: white space, and comment marks after a line break.
GAP = r"[\s*#/;]+"
CUES = rf"licen[cs]e|copyright|permission{GAP}is{GAP}hereby|warrant(?:y|ies)\b|redistribut|spdx|public{GAP}domain|creative{GAP}commons|\bcc(?:-|{GAP})by"
CUE = re.compile(CUES, re.IGNORECASE)
LEAST_REDUCTION, MOST_DIFFERENT = 0.2, 0.15
#: Longest matches that a window of a long block holds.
WINDOW = 4
#: Characters that a difference takes off a finding's length where findings overlap.
DIFFERENCE = 20
LEVEL = 9

#: The public wording of licenses and of the notices that name them.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    "LGPL-2.1": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",),
    "LGPL-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at https://www.eclipse.org/legal/epl-2.0.",),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "This work is dedicated to the public domain under CC0 1.0."),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "BSD-2-Clause": (
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
#: A word may go on after a line break at its hyphen, past comment marks.
WORD = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9.+-]*-\n[ \t*#/;]*(?=[A-Za-z0-9]))*(?:[A-Za-z0-9.+-]*[A-Za-z0-9+])?")
BREAK = re.compile(r"\n[ \t*#/;]*")
CLOSING = re.compile(r"[/.)\"']*")
#: Words that tell one license from another.
TELLING = frozenset("mit apache gnu general lesser affero mozilla bsd creative commons cc cc0 by by-nc by-sa by-nd noncommercial attribution attribution-noncommercial attribution-sharealike sharealike noderivatives attribution-noderivatives eclipse isc gpl lgpl agpl mpl 1.0 1.1 2 2.0 2.1 3 3.0 4.0 2-clause 3-clause".split())


def words_of(text: str) -> list[str]:
    return [BREAK.sub("", w).lower() for w in WORD.findall(text)]


def _given(raw: bytes) -> zstandard.ZstdCompressor:
    """The compressor with raw as its dictionary."""
    known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_dict_id=False)


@functools.cache
def _tools() -> tuple:
    """(license, words, compressor with the template as its raw dictionary), and the plain compressor."""
    plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    return tuple((name, words_of(text), _given(text.lower().encode())) for name, texts in TEMPLATES.items() for text in texts), plain


@functools.cache
def _spelled() -> tuple:
    """Of every template its words as bytes and their compressed size, and the characters of the longest word."""
    tools, plain = _tools()
    rows = [" ".join(words).encode() for _, words, _ in tools]
    return tuple((row, len(plain.compress(row))) for row in rows), max(len(w) for _, words, _ in tools for w in words)


def reductions(block: list[str]) -> list[float]:
    """By how much each template shrinks where the words of a block are known.

    Words longer than any of a template's are cut, so that no word, however long, moves others out of reach.
    """
    rows, longest = _spelled()
    packer = _given(" ".join(w[: longest + 1] for w in block).encode())
    return [(bare - len(packer.compress(row))) / bare for row, bare in rows]


def _packed(text: str) -> bytes:
    return " ".join(text.lower().split()).encode("utf-8", "surrogatepass")


def differences(template: list[str], block: list[str]) -> tuple[list[str], list[str]]:
    """Words of the template that the block lacks, and words of the block within the match that it adds."""
    same = [m for m in difflib.SequenceMatcher(None, template, block, autojunk=False).get_matching_blocks() if m.size]
    if not same:
        return template, []
    lacks, adds, at = [], [], same[0].b
    done = 0
    for m in same:
        lacks += template[done : m.a]
        adds += block[at : m.b]
        done, at = m.a + m.size, m.b + m.size
    return lacks + template[done:], adds


def places(template: list[str], block: list[str], most: int) -> list[tuple[int, int]]:
    """Word spans of the block that differ from the template by at most most words lacking or added.

    The edit distance with free ends, a row for each template word. Of ends in a run within the limit
    the nearest to the template (the first of them) counts, until its span is over.
    """
    codes = {w: i for i, w in enumerate(dict.fromkeys(template))}
    own = np.array([codes.get(w, -1) for w in block], np.int32)
    at = np.arange(len(block) + 1, dtype=np.int32)
    cost, start = np.zeros(len(block) + 1, np.int32), at.copy()
    for w in template:
        step, origin = cost + 1, start.copy()
        same = np.flatnonzero(own == codes[w])
        better = same[cost[same] <= step[same + 1]]
        step[better + 1], origin[better + 1] = cost[better], start[better]
        # Words added: the cheapest cell to the left, the nearest of equal ones.
        order = (step - at).astype(np.int64) * (len(at) + 1) - at
        least = np.minimum.accumulate(order)
        source = (-least) % (len(at) + 1)
        cost, start = step[source] + (at - source).astype(np.int32), origin[source]
    found: list[tuple[int, int, int]] = []
    for end in np.flatnonzero(cost <= most).tolist():
        one = (int(cost[end]), int(start[end]), end)
        if one[1] == end:
            continue
        if found and one[1] < found[-1][2]:
            if one[0] < found[-1][0]:
                found[-1] = one
        else:
            found.append(one)
    return [(a, b) for _, a, b in found]


@functools.lru_cache(maxsize=8192)
def judge(block: str) -> tuple:
    """(first character, end, license, reduction, differing words, verdict, wording) of every confirmed place in a block.

    A template is looked for if the block makes it shrink enough.
    """
    tools, plain = _tools()
    marks = list(WORD.finditer(block))
    own = [BREAK.sub("", m.group()).lower() for m in marks]
    found = []
    for (name, template, packer), shrunk in zip(tools, reductions(own)):
        if shrunk < LEAST_REDUCTION:
            continue
        most = int(MOST_DIFFERENT * len(template))
        for a, b in places(template, own, most):
            lacks, adds = differences(template, own[a:b])
            n = len(lacks) + len(adds)
            if n > most or TELLING & {*lacks, *adds}:
                continue
            low, stop = marks[a].start(), CLOSING.match(block, marks[b - 1].end()).end()
            span = _packed(block[low:stop])
            bare = len(plain.compress(span))
            reduction = (bare - len(packer.compress(span))) / bare
            wording = " ".join([*(f"-{w}" for w in lacks), *(f"+{w}" for w in adds)])
            found.append((low, stop, name, round(reduction, 4), n, "variant" if n else "exact", wording))
    return tuple(found)


def blocks(text: str) -> list[tuple[int, int]]:
    """Spans of candidate blocks: the words round each cue, as far as the longest template reaches.

    Blocks that meet are joined, and long ones cut to windows that share as many words as a match can
    have, so that every match lies whole in one of them.
    """
    reach = _reach()
    marks = [m.span() for m in WORD.finditer(text)]
    ends = [b for _, b in marks]
    runs: list[list[int]] = []
    for cue in CUE.finditer(text):
        i = bisect.bisect_right(ends, cue.start())
        low, stop = max(0, i - reach), min(len(marks), i + reach)
        if runs and low <= runs[-1][1]:
            runs[-1][1] = stop
        else:
            runs.append([low, stop])
    spans = []
    for low, stop in runs:
        while stop - low > WINDOW * reach:
            spans.append((marks[low][0], marks[low + WINDOW * reach - 1][1]))
            low += (WINDOW - 1) * reach
        if low < stop:
            spans.append((marks[low][0], CLOSING.match(text, marks[stop - 1][1]).end()))
    return spans


@functools.cache
def _reach() -> int:
    """Words that a match can have at most."""
    return max(len(words) + int(MOST_DIFFERENT * len(words)) for _, words, _ in _tools()[0])


def scan(text: str) -> list[dict]:
    """Findings by place; of overlapping ones that with fewer differences, then the longer one, stays.

    But a variant that holds the wording of other licenses whole, and is longer by DIFFERENCE characters for
    each of its differences, stands for them: a license that another's conditions are a part of.
    """
    found = set()
    for a, b in blocks(text):
        for low, stop, *verdict in judge(text[a:b]):
            found.add((verdict[2], low - stop, a + low, a + stop, *verdict))
    kept: list[tuple] = []
    for f in sorted(found):
        met = [k for k in kept if k[2] < f[3] and f[2] < k[3]]
        if all(f[2] <= k[2] and k[3] <= f[3] and k[4] != f[4] and k[1] - f[1] > DIFFERENCE * f[0] for k in met):
            kept = [k for k in kept if k not in met] + [f]
    return [{"start": a, "end": b, "license": name, "reduction": r, "differences": n, "verdict": v, "wording": w} for _, _, a, b, name, r, n, v, w in sorted(kept, key=lambda k: k[2])]


FINDING = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("reduction", pa.float64()), ("differences", pa.int64()), ("verdict", pa.string()), ("wording", pa.string())])
SCHEMA = "doc_id long, n_findings long, licenses string, findings array<struct<start:long,end:long,license:string,reduction:double,differences:long,verdict:string,wording:string>>"


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.columns
        found = [scan(t) if t else [] for t in texts.to_pylist()]
        names = [",".join(sorted({f["license"] for f in fs})) for fs in found]
        yield pa.RecordBatch.from_arrays([ids, pa.array([len(f) for f in found], pa.int64()), pa.array(names, pa.string()), pa.array(found, pa.list_(FINDING))], names=["doc_id", "n_findings", "licenses", "findings"])


def scan_documents(docs: DataFrame) -> DataFrame:
    """The columns of SCHEMA for every row."""
    text = text_of("text")
    cued = F.when(F.regexp_like(text, F.lit(f"(?i){CUES}")), text)
    return docs.select("doc_id", cued.alias("text")).mapInArrow(_scanned, SCHEMA)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(read(spark, sf_dir, "documents"))


QUERIES = {"op9_license_scan": op9_license_scan}
