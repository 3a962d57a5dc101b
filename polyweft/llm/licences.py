"""Licence scans by sentence rules, in Spark expressions only.

A text is cut into sentences in several ways: line by line; with its lines joined, for notices that are wrapped; and
by blocks, for licences that are wrapped and have titles, lists and copyright lines. Joined lines and blocks are cut
at semicolons as well as not. Cuts only put marks into the text, so a sentence has the same place in all of them.
A sentence is normalised (A-Z lower-cased, everything but letters and digits one space, list numbers and years and
holders of a copyright line dropped) and looked up among known licence sentences. What the cuts recognise is
merged by place. The identifiers of a text, in order, are matched against ordered rules: a rule is a run of
identifiers, longer rules come first, and a rule that matches takes its identifiers away, so that a whole licence
is not reported again as its parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: sentences of public licences and notices, normalised by ``normalised``
SENTENCES = {
    "apache-ref": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license", "released under the apache license version 2 0"],
    "apache-use": ["you may not use this file except in compliance with the license"],
    "apache-copy": ["you may obtain a copy of the license at http www apache org licenses license 2 0"],
    "apache-asis": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "apache-see": ["see the license for the specific language governing permissions and limitations under the license"],
    "mit-ref": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit-asis": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "mit-liability": ["in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "bsd-asis": ["this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"],
    "bsd-liability": ["in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"],
    "isc-asis": ["the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"],
    "apache-text": ["license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document"],
    "gpl3-text": ["the gnu general public license is a free copyleft license for software and other kinds of works"],
    "gpl2-text": ["by contrast the gnu general public license is intended to guarantee your freedom to share and change free software to make sure the software is free for all its users"],
    "isc-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd-name": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd-ref": ["licensed under the bsd 3 clause license", "released under the bsd license", "licensed under the bsd license"],
    "gpl-free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl2-free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "gpl-hope": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "gpl-see": ["see the gnu general public license for more details"],
    "gpl-ref": ["licensed under the gnu general public license v3", "licensed under the gpl v3", "licensed under the gnu general public license version 3"],
    "lgpl-ref": ["licensed under the gnu lesser general public license v3", "licensed under the lgpl v3"],
    "mpl-ref": ["this source code form is subject to the terms of the mozilla public license v", "licensed under the mozilla public license 2 0"],
    "cc-by": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by-nd": ["licensed under cc by nd 4 0"],
    "cc-by-nc-sa": ["licensed under cc by nc sa 4 0"],
    "cc-by-nc-nd": ["licensed under cc by nc nd 4 0"],
    "cc0": ["licensed under cc0 1 0", "released under cc0 1 0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
    "public-domain": ["this work is in the public domain", "released into the public domain", "this is free and unencumbered software released into the public domain"],
    "reserved": ["all rights reserved", "copyright all rights reserved"],
}

# fixed values: rules in the order they are tried
RULES = [
    ("Apache-2.0", ("apache-ref", "apache-use", "apache-copy", "apache-asis", "apache-see")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name", "bsd-asis", "bsd-liability")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-asis", "bsd-liability")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("MIT", ("mit-grant", "mit-notice", "mit-asis", "mit-liability")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-see")),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope", "gpl-see")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("ISC", ("isc-grant", "isc-asis")),
    ("ISC", ("isc-grant",)),
    ("Apache-2.0", ("apache-text",)),
    ("GPL-3.0-only", ("gpl3-text",)),
    ("GPL-2.0-only", ("gpl2-text",)),
    ("Apache-2.0", ("apache-ref",)),
    ("MIT", ("mit-ref",)),
    ("BSD-3-Clause", ("bsd-ref",)),
    ("GPL-3.0-only", ("gpl-ref",)),
    ("LGPL-3.0-only", ("lgpl-ref",)),
    ("MPL-2.0", ("mpl-ref",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-ND-4.0", ("cc-by-nd",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC0-1.0", ("cc0",)),
    ("Public-Domain", ("public-domain",)),
    ("Proprietary", ("reserved",)),
]

# fixed values: licence names as they stand after SPDX-License-Identifier
SPDX = (
    "Apache-2.0", "MIT", "MIT-0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "Zlib", "Unlicense", "MPL-2.0", "EPL-2.0", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only",
    "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "BSL-1.0",
)

#: Every known sentence has one of these; texts and sentences without any are passed over.
ANCHOR = r"(?i)licens|permission|warrant|redistribut|copyright|public\s+domain|rights\s+reserved|gpl|cc0|free\s+software|in\s+no\s+event\s+shall"
MARK, JOINT = "\x01", "\x03"
#: Pattern and what takes its place: strings and numbers of groups.
_STOPS = (r"([.!?])([ \t\n\f])", (1, MARK, 2))
_STOPS_OR_SEMICOLONS = (r"([.!?;])([ \t\n\f])", (1, MARK, 2))
_LINES = (r"(\n)", (MARK, 1))
#: Blocks end at blank lines (but not inside "a copy of the License at" and its address), after a colon that ends a line (but not "free
#: software:") and before list marks; a line with holder and year stands alone.
_BLOCKS = (
    (r"( at[ \t]*)\n", (1, JOINT)),
    (r"(?i)(software:[ \t]*)\n", (1, JOINT)),
    (r"(?im)^([^\p{L}\p{N}\n]*copyright[^\p{L}\p{N}\n][^\n]*[0-9]{4}[^\n]*)$", (MARK, 1, MARK)),
    (r"\n([ \t]*\n)", (MARK, "\n", 1)),
    (r"(:[ \t]*\n)", (1, MARK)),
    (r"\n([ \t]*(?:\(?[0-9]{1,2}[.)]|[*-])[ \t])", ("\n", MARK, 1)),
)
CUTS = ((_LINES, _STOPS_OR_SEMICOLONS), (_STOPS_OR_SEMICOLONS,), (_STOPS,), (*_BLOCKS, _STOPS_OR_SEMICOLONS), (*_BLOCKS, _STOPS))
COPYRIGHT = r"^(copyright)( c)?( [0-9]{4})+( [a-z0-9 ]*?)?( all rights reserved)$"
LIST_NUMBER = r"^[0-9]{1,2} "
SIGNS, LEAD = r"[^\p{L}\p{N}]+", r"^[^\p{L}\p{N}]*"


def known() -> dict[str, str]:
    """Normalised sentences to identifiers."""
    tags = {f"spdx license identifier {' '.join(name.lower().replace('.', ' ').split('-'))}": f"spdx-{name.lower()}" for name in SPDX}
    return {s: i for i, sentences in SENTENCES.items() for s in sentences} | tags


def rules() -> list[tuple[str, tuple[str, ...]]]:
    return RULES + [(name, (f"spdx-{name.lower()}",)) for name in SPDX]


def normalised(sentence: Column) -> Column:
    low = F.trim(F.regexp_replace(F.lower(sentence), SIGNS, " "))
    return F.regexp_replace(F.regexp_replace(low, LIST_NUMBER, ""), COPYRIGHT, "$1$5")


def _identified(text: Column, cut: tuple) -> Column:
    """(place, identifier) of the known sentences of one cut."""
    for pattern, put in cut:
        # lines end at a line feed alone
        text = F.regexp_replace(text, pattern.replace("(?im)", "(?dim)"), "".join(f"${x}" if isinstance(x, int) else x for x in put))
    table = F.create_map(*[F.lit(x) for pair in known().items() for x in pair])
    none = F.expr("cast(array() as array<struct<at:int,id:string>>)")
    place = lambda s, x: s["at"] + F.length(F.regexp_extract(x, LEAD, 0))
    new = lambda s, x: F.filter(F.array(F.struct(place(s, x).alias("at"), F.try_element_at(table, normalised(x)).alias("id"))), lambda r: r["id"].isNotNull())
    step = lambda s, x: F.struct((s["at"] + F.length(x)).alias("at"), F.when(x.rlike(ANCHOR), F.concat(s["found"], new(s, x))).otherwise(s["found"]).alias("found"))
    return F.aggregate(F.split(text, MARK), F.struct(F.lit(0).alias("at"), none.alias("found")), step, lambda s: s["found"])


def _applied(ids: Column) -> Column:
    """Names of the licences whose rules match, in the order of the rules."""
    runs = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("," + ",,".join(run) + ",").alias("run")) for name, run in rules()])
    # identifiers stand as ",a,,b,"
    line = F.concat(F.lit(","), F.array_join(ids, ",,"), F.lit(","))
    state = F.struct(line.alias("line"), F.expr("cast(array() as array<string>)").alias("names"))
    step = lambda s, r: F.when(F.contains(s["line"], r["run"]), F.struct(F.replace(s["line"], r["run"], F.lit(",;,")).alias("line"), F.concat(s["names"], F.array(r["name"])).alias("names"))).otherwise(s)
    return F.array_distinct(F.aggregate(runs, state, step, lambda s: s["names"]))


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sentences (identifiers in order), licences (in the order of the rules) and has_licence of every row.

    Null and empty texts have none. Repeated sentences are identified each time and named once. Rows that repeat
    an id are scanned each, ids may be of any type, null too. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("\r"), F.lit(" ")).alias("text"))
    none = F.expr("cast(array() as array<string>)")
    merged = F.array_sort(F.array_distinct(F.concat(*[_identified(F.col("text"), cut) for cut in CUTS])))
    ids = rows.select("doc_id", F.when(F.col("text").rlike(ANCHOR), F.transform(merged, lambda r: r["id"])).otherwise(none).alias("sentences"))
    return ids.select("doc_id", "sentences", F.when(F.size("sentences") > 0, _applied(F.col("sentences"))).otherwise(none).alias("licences")).withColumn("has_licence", F.size("licences") > 0)


def oracle() -> str:
    """The scan in DuckDB's SQL, as rows of the query."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    table = "map([" + ", ".join(quoted(s) for s in known()) + "], [" + ", ".join(quoted(i) for i in known().values()) + "])"
    has = lambda x: f"regexp_matches({x}, {quoted(ANCHOR)})"

    def pieces(cut: tuple) -> str:
        text = "text"
        for pattern, put in cut:
            to = " || ".join(f"'\\{x}'" if isinstance(x, int) else f"chr({ord(x)})" for x in put)
            text = f"regexp_replace({text}, {quoted(pattern)}, {to}, 'g')"
        return f"string_split({text}, chr(1))"

    normal = f"regexp_replace(regexp_replace(trim(regexp_replace(lower(x), '{SIGNS}', ' ', 'g')), '{LIST_NUMBER}', ''), {quoted(COPYRIGHT)}, '\\1\\5')"
    place = lambda p: f"length(array_to_string({p}[:i - 1], '')) + length(regexp_extract(x, '{LEAD}'))"
    look = lambda p: f"list_filter(list_transform({p}, lambda x, i: case when {has('x')} then {{'at': {place(p)}, 'id': map_extract_value(k.t, {normal})}} end), lambda r: r.id is not null)"
    cuts = ", ".join(f"{pieces(cut)} as p{n}" for n, cut in enumerate(CUTS))
    found = " || ".join(look(f"p{n}") for n in range(len(CUTS)))
    line = "',' || array_to_string(sentences, ',,') || ','"
    names, text = [], "line"
    for name, run in rules():
        wanted = quoted("," + ",,".join(run) + ",")
        names.append(f"case when contains({text}, {wanted}) then {quoted(name)} end")
        text = f"replace({text}, {wanted}, ',;,')"
    return f"""
with k as (select {table} as t),
d as (select doc_id, replace(coalesce(text, ''), chr(13), ' ') as text from documents),
anchored as (select doc_id, {cuts} from d where {has("text")}),
merged as (select doc_id, list_transform(list_sort(list_distinct({found})), lambda r: r.id) as sentences from anchored, k),
chosen as (select d.doc_id, coalesce(sentences, []::varchar[]) as sentences from d left join merged using (doc_id)),
lined as (select doc_id, sentences, {line} as line from chosen),
named as (select doc_id, sentences, list_filter([{', '.join(names)}], lambda n: n is not null) as raw from lined),
once as (select doc_id, sentences, list_filter(raw, lambda n, i: list_position(raw, n) = i) as licences from named)
select doc_id, array_to_string(sentences, ',') as sentences, array_to_string(licences, ',') as licences, len(licences) > 0 as has_licence from once
"""
