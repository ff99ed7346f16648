"""License recognition by rules over sentences, in DataFrame functions only.

A text is cut into sentences, each sentence is normalised and looked up among the known license sentences,
and the sequence of identifiers found is matched against ordered rules: a rule is a sequence of
identifiers that must follow one another without another sentence between them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotweave.llm.common import named

# Short identifiers of the SPDX list.
SPDX = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later",
        "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "Unlicense", "Zlib", "BSL-1.0", "EPL-2.0",
        "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")

# Identifier -> sentence as published, compared after normalisation.
SENTENCES = {
    "mit_ref": "Released under the MIT License.",
    "mit_ref_2": "Licensed under the MIT License.",
    "mit_ref_3": "This project is licensed under the MIT License.",
    "mit_grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit_notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "as_is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "apache_ref": "Licensed under the Apache License, Version 2.0.",
    "apache_head": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache_copy": "You may obtain a copy of the License at",
    "apache_url": "http://www.apache.org/licenses/LICENSE-2.0",
    "apache_basis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache_see": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl3_ref": "This work is licensed under the GNU General Public License, version 3.",
    "gpl3_or_later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2_or_later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl_hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl_see": "See the GNU General Public License for more details.",
    "cc_by_nc": "Licensed under CC BY-NC 4.0.",
    "cc_by": "Licensed under CC BY 4.0.",
    "cc_by_sa": "Licensed under CC BY-SA 4.0.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "bsd_grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd_source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd_names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd_as_is": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "isc_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc_as_is": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "mpl2_subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl2_copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mpl2_copy_2": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "lgpl21_or_later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3_or_later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl_hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl_see": "See the GNU Lesser General Public License for more details.",
    "agpl3_or_later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl_see": "See the GNU Affero General Public License for more details.",
    "unlicense_domain": "This is free and unencumbered software released into the public domain.",
    "unlicense_free": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib_as_is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib_liable": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib_grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "bsl_grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "bsl_ref": "Distributed under the Boost Software License, Version 1.0.",
    "epl2_ref": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "reserved": "All rights reserved.",
    **{f"spdx_{name}": f"SPDX-License-Identifier: {name}" for name in SPDX},
}

RESERVED = "proprietary"  # a verdict only where a document holds no other: many licenses begin with these words

# Fixed values: (rule, license, identifiers in order); longer rules stand before the shorter ones they begin with.
RULES = (
    ("mit_full", "MIT", ("mit_grant", "mit_notice", "as_is")),
    ("mit_short", "MIT", ("mit_grant", "mit_notice")),
    ("mit_reference", "MIT", ("mit_ref",)), ("mit_reference_2", "MIT", ("mit_ref_2",)), ("mit_reference_3", "MIT", ("mit_ref_3",)),
    ("mit_grant", "MIT", ("mit_grant",)),
    ("apache_header", "Apache-2.0", ("apache_head", "apache_copy", "apache_url", "apache_basis", "apache_see")),
    ("apache_notice", "Apache-2.0", ("apache_head",)), ("apache_reference", "Apache-2.0", ("apache_ref",)),
    ("apache_url", "Apache-2.0", ("apache_url",)),
    ("gpl3_header", "GPL-3.0-or-later", ("gpl3_or_later", "gpl_hope", "gpl_see")), ("gpl3_grant", "GPL-3.0-or-later", ("gpl3_or_later",)),
    ("gpl2_header", "GPL-2.0-or-later", ("gpl2_or_later", "gpl_hope", "gpl_see")), ("gpl2_grant", "GPL-2.0-or-later", ("gpl2_or_later",)),
    ("gpl3_reference", "GPL-3.0-only", ("gpl3_ref",)),
    ("cc_by_nc", "CC-BY-NC-4.0", ("cc_by_nc",)), ("cc_by_sa", "CC-BY-SA-4.0", ("cc_by_sa",)), ("cc_by", "CC-BY-4.0", ("cc_by",)),
    ("cc0", "CC0-1.0", ("cc0",)),
    ("bsd3_full", "BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_names", "bsd_as_is")),
    ("bsd3", "BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_names")),
    ("bsd2_full", "BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_as_is")), ("bsd2", "BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("bsd_grant", "BSD", ("bsd_grant",)),
    ("isc_full", "ISC", ("isc_grant", "isc_as_is")), ("isc_grant", "ISC", ("isc_grant",)),
    ("mpl2_notice", "MPL-2.0", ("mpl2_subject", "mpl2_copy")), ("mpl2_notice_2", "MPL-2.0", ("mpl2_subject", "mpl2_copy_2")), ("mpl2_subject", "MPL-2.0", ("mpl2_subject",)),
    ("lgpl21_header", "LGPL-2.1-or-later", ("lgpl21_or_later", "lgpl_hope", "lgpl_see")), ("lgpl21_grant", "LGPL-2.1-or-later", ("lgpl21_or_later",)),
    ("lgpl3_header", "LGPL-3.0-or-later", ("lgpl3_or_later", "gpl_hope", "lgpl_see")), ("lgpl3_grant", "LGPL-3.0-or-later", ("lgpl3_or_later",)),
    ("agpl3_header", "AGPL-3.0-or-later", ("agpl3_or_later", "gpl_hope", "agpl_see")), ("agpl3_grant", "AGPL-3.0-or-later", ("agpl3_or_later",)),
    ("unlicense_full", "Unlicense", ("unlicense_domain", "unlicense_free")), ("unlicense", "Unlicense", ("unlicense_domain",)),
    ("zlib_full", "Zlib", ("zlib_as_is", "zlib_liable", "zlib_grant")), ("zlib_grant", "Zlib", ("zlib_grant",)),
    ("bsl_grant", "BSL-1.0", ("bsl_grant",)), ("bsl_reference", "BSL-1.0", ("bsl_ref",)), ("epl2_reference", "EPL-2.0", ("epl2_ref",)),
    *((f"spdx_{name}", name, (f"spdx_{name}",)) for name in SPDX),
    ("reserved", RESERVED, ("reserved",)),
)

BOUNDARY = r"([.!?:])[\x20\x09-\x0D]+"  # a mark and white space end a piece, as does a line break
NOT_WORD = r"[^\p{L}\p{N}]+"
LIST_MARK = "^([0-9]{1,2}|[a-z]|[ivx]{1,4})$"  # a piece that only numbers an item of a list


def normalise(sentence: Column) -> Column:
    """Lower case, every run of anything but letters and digits one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(sentence), NOT_WORD, " "))


def sentences(text: Column) -> Column:
    """Normalised non-empty pieces of the whole text in order: its sentences, cut at every line break too, without marks of lists."""
    parts = F.split(F.regexp_replace(text, BOUNDARY, "$1\n"), "\n")
    return F.filter(F.transform(parts, normalise), lambda s: (s != "") & ~s.rlike(LIST_MARK))


def _plain(text: str) -> str:
    return " ".join("".join(c if c.isalnum() else " " for c in text.lower()).split())


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", known: Mapping[str, str] = SENTENCES,
         rules: Sequence[tuple[str, str, tuple[str, ...]]] = RULES) -> DataFrame:
    """One row per recognised rule: ``doc_id``, ``rule``, ``license``, ``first_sentence``, ``n_sentences``.

    A known sentence is one piece of the text or a run of pieces, so it may be wrapped over any number of lines, with comment leaders
    or without, and hold marks itself; where several begin at a piece the longest counts, and none begins inside another.
    ``first_sentence`` counts the document's non-empty pieces from 0, ``n_sentences`` the rule's known sentences. Rules are tried in their order
    at every known sentence; a sentence that a rule has used starts no other. "All rights reserved" says something only in a document
    without any other rule. Null, empty and license-free texts give no row; repeated
    rows give theirs each; other columns are ignored. No shuffle: every document is scanned in its own row.
    """
    by_text = dict(sorted(((_plain(sentence), name) for name, sentence in known.items()), key=lambda pair: -len(pair[0])))
    # Few documents hold a known sentence; the others end here.
    joined = F.concat(F.lit(" "), F.concat_ws(" ", "s"), F.lit(" "))
    holds = F.lit(False)
    for sentence in by_text:
        holds = holds | F.col("joined").contains(f" {sentence} ")
    found = (docs.select(named(key).alias("doc_id"), sentences(named(text)).alias("s")).withColumn("joined", joined).filter(holds).select("doc_id", "s"))

    def known_at(x: Column, i: Column) -> Column:
        """The longest known sentence that pieces from the one at ``i`` make up, with the number of pieces."""
        hit = F.lit(None).cast("struct<at:int,pieces:int,id:string>")
        for sentence, name in reversed(by_text.items()):
            # A piece has a word at least, so that many pieces hold the sentence.
            run = F.concat(F.array_join(F.slice("s", i + 1, len(sentence.split())), "\n"), F.lit("\n"))
            begun = F.substring(run, 1, len(sentence) + 1)
            fits = F.lit(f"{sentence} ").startswith(F.concat(x, F.lit(" "))) & begun.endswith("\n") & (F.translate(begun, "\n", " ") == f"{sentence} ")
            hit = F.when(fits, F.struct(i.alias("at"), (F.size(F.split(begun, "\n")) - 1).alias("pieces"), F.lit(name).alias("id"))).otherwise(hit)
        return hit

    starts = F.filter(F.transform("s", known_at), lambda x: x.isNotNull())
    kept = "cast(named_struct('upto', 0, 'kept', array()) as struct<upto:int,kept:array<struct<at:int,pieces:int,id:string>>>)"
    apart = F.aggregate(starts, F.expr(kept), lambda acc, x: F.when(x["at"] < acc["upto"], acc).otherwise(
        F.struct((x["at"] + x["pieces"]).alias("upto"), F.concat(acc["kept"], F.array(x)).alias("kept"))))["kept"]
    found = found.select("doc_id", apart.alias("ids"))

    def rule_at(i: Column) -> Column:
        tried = F.lit(None).cast("struct<rule:string,license:string,n:int>")
        for rule, license_, ids in reversed(rules):
            every = F.lit(True)
            for k, name in enumerate(ids):
                this, last = F.get("ids", i + k), F.get("ids", i + k - 1)
                follows = this["at"] == last["at"] + last["pieces"] if k else F.lit(True)
                every = every & F.coalesce((this["id"] == name) & follows, F.lit(False))
            tried = F.when(every, F.struct(F.lit(rule).alias("rule"), F.lit(license_).alias("license"), F.lit(len(ids)).alias("n"))).otherwise(tried)
        return tried

    located = F.filter(F.transform("ids", lambda x, i: F.struct(x["at"].alias("at"), i.alias("place"), rule_at(i).alias("hit"))), lambda x: x["hit"].isNotNull())
    # From left to right, leaving out what begins inside the hit before.
    empty = "cast(named_struct('upto', 0, 'hits', array()) as struct<upto:int,hits:array<struct<at:int,place:int,hit:struct<rule:string,license:string,n:int>>>>)"
    chosen = F.aggregate(located, F.expr(empty), lambda acc, x: F.when(x["place"] < acc["upto"], acc).otherwise(
        F.struct((x["place"] + x["hit"]["n"]).alias("upto"), F.concat(acc["hits"], F.array(x)).alias("hits"))))
    licensed = F.exists("hits", lambda x: x["hit"]["license"] != RESERVED)
    verdicts = F.when(licensed, F.filter("hits", lambda x: x["hit"]["license"] != RESERVED)).otherwise(F.col("hits"))
    return (found.select("doc_id", chosen["hits"].alias("hits")).select("doc_id", F.explode(verdicts).alias("x"))
            .select("doc_id", "x.hit.rule", "x.hit.license", F.col("x.at").alias("first_sentence"), F.col("x.hit.n").alias("n_sentences")))


def oracle() -> str:
    """The scan of ``documents`` as a DuckDB statement; rules longer than the rest are tried first by their order."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(_plain(s))}, {quote(n)})" for n, s in SENTENCES.items())
    listed = ", ".join(f"({i}, {quote(r)}, {quote(lic)}, {quote(' '.join(ids))}, {len(ids)})" for i, (r, lic, ids) in enumerate(RULES))
    return f"""
WITH RECURSIVE known(s, id) AS (VALUES {known}), rules(place, rule, license, ids, n) AS (VALUES {listed}),
cut AS (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?:])[\\x20\\x09-\\x0D]+', '\\1' || chr(10), 'g'), chr(10)),
         lambda s: trim(regexp_replace(lower(s), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))), lambda s: s <> '' AND NOT regexp_matches(s, '{LIST_MARK}')) AS s FROM documents),
flat AS (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) - 1 AS pos FROM cut),
ids AS (SELECT doc_id, pos, id FROM flat JOIN known USING (s)),
runs AS (
  SELECT a.doc_id, a.pos, r.place, r.rule, r.license, r.n,
         row_number() OVER (PARTITION BY a.doc_id, a.pos ORDER BY r.place) AS pick
  FROM ids a JOIN rules r ON r.ids = (SELECT string_agg(b.id, ' ' ORDER BY b.pos) FROM ids b WHERE b.doc_id = a.doc_id AND b.pos >= a.pos AND b.pos < a.pos + r.n)),
hits AS (SELECT * FROM runs WHERE pick = 1),
walk AS (
  SELECT doc_id, pos, rule, license, n FROM hits h WHERE NOT EXISTS (SELECT 1 FROM hits p WHERE p.doc_id = h.doc_id AND p.pos < h.pos)
  UNION ALL
  SELECT h.doc_id, h.pos, h.rule, h.license, h.n FROM walk w JOIN hits h ON h.doc_id = w.doc_id AND h.pos >= w.pos + w.n
    AND NOT EXISTS (SELECT 1 FROM hits p WHERE p.doc_id = h.doc_id AND p.pos >= w.pos + w.n AND p.pos < h.pos))
SELECT doc_id, rule, license, pos::INTEGER AS first_sentence, n::INTEGER AS n_sentences FROM walk
WHERE license <> '{RESERVED}' OR doc_id NOT IN (SELECT doc_id FROM walk WHERE license <> '{RESERVED}')"""
