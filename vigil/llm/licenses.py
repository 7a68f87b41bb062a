"""License scans over a positional rare-token index.

A template is a licence's text, cut into words. Its postings are the runs of
words of four letters and more (and its mandatory phrases, whole), each under
its offset in the template. One pass over the texts keeps the places of licence
words in each file; from these it is counted in how many files each occurs. A
file is tried against the templates whose mandatory words it all holds: the two
of them with the highest IDF are looked up, each place proposes a start (place
minus offset), and the starts of both are intersected. What remains is verified:
the first mandatory phrase stands exactly there, every other one within
``slack`` words of its place (a name or a year may be put in). A verified
template counts if enough of its runs stand likewise.

The counts are a bounded table, one row per licence word. All else happens
inside a document's row with SQL array functions, as intersections of lists of
places, which take time in proportion to the lists: no shuffle.

``lower`` differs from folding A-Z only where a capital outside ASCII has
ASCII letters in lower case: the Kelvin sign, a k, which another letter outside
ASCII stands in for, and the dotted I, an i with a combining dot, which as a
word character keeps the word different from any of ASCII letters.

Defined results: a null or empty text has no words, score 0 and empty labels;
rows are scanned one by one, so repeated rows and ids give repeated results; a
null id stays null; an empty table gives an empty table; columns other than id
and text are not looked at.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import quoted, stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Label, words of the text, key phrases (all mandatory). The
# first three are the base phrases, then openings and names of public licences.
BASE = (
    ("mit", "mit license", ("mit license",)),
    ("apache", "apache license", ("apache license",)),
    ("gpl", "general public license", ("general public license",)),
)
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
     ("permission is hereby granted free of charge", "obtaining a copy of this software")),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
     ("apache license version 2 0", "in compliance with the license")),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
     ("gnu general public license",)),
    ("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    ("agpl", "gnu affero general public license", ("affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
     ("redistribution and use in source and binary forms", "following conditions are met")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     ("permission to use copy modify", "for any purpose with or without fee is hereby granted")),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", ("mozilla public license",)),
    ("epl", "eclipse public license", ("eclipse public license",)),
    ("cc", "licensed under cc by", ("licensed under cc by",)),
    ("cc", "creative commons attribution", ("creative commons attribution",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
)
# Whole texts of public licences (of the longest, the notice that files carry), punctuation left out.
TEXTS = (
    ("mit",
     "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
     "the software to deal in the software without restriction including without limitation the rights to use copy modify merge "
     "publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do "
     "so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or "
     "substantial portions of the software the software is provided as is without warranty of any kind express or implied including "
     "but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the "
     "authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or "
     "otherwise arising from out of or in connection with the software or the use or other dealings in the software",
     ("hereby granted free of charge", "without warranty of any kind", "other dealings in the software")),
    ("apache",
     "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you "
     "may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in "
     "writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind "
     "either express or implied see the license for the specific language governing permissions and limitations under the license",
     ("apache license version 2 0", "unless required by applicable law", "specific language governing permissions")),
    ("gpl",
     "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
     "published by the free software foundation either version 3 of the license or at your option any later version this program is "
     "distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or "
     "fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu "
     "general public license along with this program",
     ("gnu general public license", "hope that it will be useful", "even the implied warranty")),
    ("bsd",
     "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
     "conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the "
     "following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
     "following disclaimer in the documentation and or other materials provided with the distribution this software is provided by "
     "the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied "
     "warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or "
     "contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited "
     "to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any "
     "theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of "
     "the use of this software even if advised of the possibility of such damage",
     ("source and binary forms", "procurement of substitute goods", "possibility of such damage")),
    ("isc",
     "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided "
     "that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author "
     "disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no "
     "event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting "
     "from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in "
     "connection with the use or performance of this software",
     ("with or without fee", "author disclaims all warranties", "other tortious action")),
    ("zlib",
     "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any "
     "damages arising from the use of this software permission is granted to anyone to use this software for any purpose including "
     "commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this "
     "software must not be misrepresented you must not claim that you wrote the original software if you use this software in a "
     "product an acknowledgment in the product documentation would be appreciated but is not required altered source versions must be "
     "plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered "
     "from any source distribution",
     ("alter it and redistribute it freely", "must not be misrepresented", "plainly marked as such")),
    ("unlicense",
     "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell "
     "or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and "
     "by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all "
     "copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to "
     "the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all "
     "present and future rights to this software under copyright law",
     ("unencumbered software released into the public domain", "detriment of our heirs and successors")),
)
SHORT = 4         # letters from which a word is indexed by itself
SLACK = 8         # words by which a phrase may stand away from its place
MIN_SHARE = 0.6   # of a template's runs that must stand


@dataclass(frozen=True)
class Phrase:
    offset: int
    words: tuple[str, ...]


@dataclass(frozen=True)
class Template:
    label: str
    mandatory: tuple[Phrase, ...]  # in the order of the text
    runs: tuple[Phrase, ...]       # what the share is of, the mandatory phrases among them
    base: bool

    @staticmethod
    def of(label: str, text: str, phrases: tuple[str, ...], base: bool = False) -> Template:
        """``text`` in lower case, its words parted by spaces; the phrases are found at their first place in it."""
        words = tuple(text.split())
        mandatory = []
        for part in (tuple(p.split()) for p in phrases):
            at = [i for i in range(len(words)) if words[i:i + len(part)] == part]
            if not part or not at:
                raise ValueError(f"{' '.join(part)!r} is not in its template")
            mandatory.append(Phrase(at[0], part))
        if not mandatory:
            raise ValueError("a template needs a mandatory phrase")
        runs = []
        for indexed, group in groupby(range(len(words)), lambda i: len(words[i]) >= SHORT):
            at = list(group)
            if indexed and len(at) > 1:
                runs.append(Phrase(at[0], words[at[0]:at[-1] + 1]))
        mandatory.sort(key=lambda p: p.offset)
        return Template(label, tuple(mandatory), tuple(sorted({*runs, *mandatory}, key=lambda p: (p.offset, p.words))), base)

    def keys(self) -> list[tuple[int, str]]:
        return sorted({(p.offset + i, w) for p in self.mandatory for i, w in enumerate(p.words)})


TEMPLATES = tuple(Template.of(*t, base=True) for t in BASE) + tuple(Template.of(*t) for t in NOTICES + TEXTS)


def document_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ"))), F.lit(WORD), F.lit(0))


def licence_words(docs: DataFrame, templates: tuple[Template, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, ``n_words``, the different licence words ``present`` and their places ``hits`` (word w, place i)."""
    vocabulary = sorted({w for t in templates for p in t.runs for w in p.words})
    words = docs.select(F.col(quoted(id_col)).alias("id"), document_words(F.col(quoted(text_col))).alias("words"))
    hits = F.filter(F.transform("words", lambda w, i: F.when(w.isin(vocabulary), F.struct(w.alias("w"), i.alias("i")))), lambda h: h.isNotNull())
    rows = words.select("id", F.size("words").cast("long").alias("n_words"), hits.alias("hits"))
    return rows.withColumn("present", F.array_distinct(F.transform("hits", lambda h: h["w"])))


def document_frequency(found: DataFrame) -> dict[str, int]:
    """Documents that hold each licence word, counted over all documents: one row per word of the templates."""
    return {r["word"]: r["n"] for r in found.select(F.explode("present").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}


_PHRASE = "struct<o:int,words:array<string>>"
_KEY = "struct<o:int,w:string>"
INDEX = (f"array<struct<template:int,label:string,base:boolean,needed:array<string>,rare:{_KEY},next:{_KEY},first:{_PHRASE},"
         f"mandatory:array<{_PHRASE}>,runs:array<{_PHRASE}>>>")


def _index(templates: tuple[Template, ...], frequency: dict[str, int]) -> Column:
    """The templates as one constant (``INDEX``), the rarest words and phrases first."""

    def phrase(p: Phrase) -> dict:
        return {"o": p.offset, "words": p.words}

    def described(n: int, t: Template) -> dict:
        keys = sorted(t.keys(), key=lambda k: (frequency.get(k[1], 0), k))  # highest IDF first
        rare = [{"o": o, "w": w} for o, w in (keys[0], keys[min(1, len(keys) - 1)])]
        by_rarity = sorted(t.mandatory, key=lambda p: min(frequency.get(w, 0) for w in p.words))
        return {"template": n, "label": t.label, "base": t.base, "needed": list(dict.fromkeys(w for _, w in keys)), "rare": rare[0],
                "next": rare[1], "first": phrase(t.mandatory[0]), "mandatory": list(map(phrase, by_rarity)), "runs": list(map(phrase, t.runs))}

    return F.from_json(F.lit(json.dumps([described(n, t) for n, t in enumerate(templates)])), INDEX)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES,
         min_share: float = MIN_SHARE, slack: int = SLACK) -> DataFrame:
    """One row per document: id, n_words, and ``places``, an array of (template, label, base, start, share)."""
    found = stored(licence_words(docs, templates, id_col, text_col), "licence-words")
    index = _index(templates, document_frequency(found))

    def places(word: Column) -> Column:
        return F.transform(F.filter("hits", lambda h: h["w"] == word), lambda h: h["i"])

    def starts(phrase: Column) -> Column:  # of the template, for every place where the phrase stands
        each = F.transform(phrase["words"], lambda w, j: F.transform(places(w), lambda i: i - j - phrase["o"]))
        return F.aggregate(F.slice(each, 2, F.greatest(F.size(each) - 1, F.lit(0))), F.get(each, F.lit(0)), F.array_intersect)

    def near(at: Column) -> Column:
        return F.flatten(F.transform(at, lambda a: F.sequence(a - slack, a + slack)))

    def looked_up(word: Column) -> Column:
        return near(F.transform(places(word["w"]), lambda i: i - word["o"]))

    def verified(t: Column) -> Column:
        met = F.array_intersect(looked_up(t["rare"]), looked_up(t["next"]))
        exact = F.array_intersect(starts(t["first"]), met)
        return F.aggregate(t["mandatory"], exact, lambda left, p: F.when(F.size(left) == 0, left).otherwise(F.array_intersect(left, near(starts(p)))))

    def judged(t: Column, at: Column) -> Column:
        standing = F.transform(t["runs"], lambda p: F.array_intersect(at, near(starts(p))))
        return F.transform(at, lambda a: F.struct(
            t["template"].alias("template"), t["label"].alias("label"), t["base"].alias("base"), a.alias("start"),
            (F.size(F.filter(standing, lambda s: F.array_contains(s, a))) / F.size(t["runs"])).alias("share")))

    nothing = F.array().cast("array<struct<template:int,label:string,base:boolean,start:int,share:double>>")
    tried = F.filter(index, lambda t: F.size(F.array_except(t["needed"], F.col("present"))) == 0)
    met = F.filter(F.transform(tried, lambda t: F.struct(t.alias("t"), verified(t).alias("at"))), lambda m: F.size(m["at"]) > 0)
    one = F.transform("met", lambda m: F.when(F.size(m["t"]["runs"]) == 1, F.transform(m["at"], lambda a: F.struct(
        m["t"]["template"].alias("template"), m["t"]["label"].alias("label"), m["t"]["base"].alias("base"), a.alias("start"),
        F.lit(1.0).alias("share")))).otherwise(judged(m["t"], m["at"])))
    rows = found.withColumn("met", met).withColumn("places", F.when(F.size("met") == 0, nothing).otherwise(F.flatten(one)))
    return rows.select(F.col("id").alias(id_col), "n_words", F.filter("places", lambda p: p["share"] >= F.lit(min_share)).alias("places"))


def summary(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    base = F.filter("places", lambda p: p["base"])

    def joined(places):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")

    starts = F.transform(base, lambda p: p["start"].cast("long"))
    return found.select(
        id_col, "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"), joined(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"))


def oracle_sql(templates: tuple[Template, ...] = TEMPLATES, min_share: float = MIN_SHARE, slack: int = SLACK) -> str:
    """The same result from a plain search of every text for every phrase (DuckDB)."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    ahead = "".join(f", lead(word, {k}) OVER near" for k in range(1, max(len(p.words) for t in templates for p in t.runs)))
    phrases = ", ".join(
        f"({n}, '{t.label}', {t.base}, {len(t.runs)}, {p.offset}, {len(p.words)}, '{p.words[0]}', '{' '.join(p.words)}', "
        f"{p in t.mandatory}, {p == t.mandatory[0]}, {len(t.mandatory)})" for n, t in enumerate(templates) for p in t.runs)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{pattern}') AS words FROM documents),
phrase(template, label, base, runs, o, len, head, phrase, mandatory, first, needed) AS (VALUES {phrases}),
w AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM d),
a AS (SELECT r, i, word, concat_ws(' ', word{ahead}) || ' ' AS ahead FROM w WINDOW near AS (PARTITION BY r ORDER BY i)),
occ AS (SELECT r, i - o AS start, p.* FROM a JOIN phrase p ON word = head WHERE starts_with(ahead, p.phrase || ' ')),
met AS (SELECT f.r, f.template, f.label, f.base, f.runs, f.needed, f.start, count(DISTINCT (o.o, o.len)) AS standing,
               count(DISTINCT CASE WHEN o.mandatory THEN (o.o, o.len) END) AS verified
        FROM occ f JOIN occ o ON f.r = o.r AND f.template = o.template AND o.start BETWEEN f.start - {slack} AND f.start + {slack}
        WHERE f.first AND (NOT o.first OR o.start = f.start) GROUP BY ALL),
p AS (SELECT *, standing / runs::DOUBLE AS share FROM met WHERE verified = needed AND standing / runs::DOUBLE >= {min_share}),
s AS (SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
             list(DISTINCT label) FILTER (base) AS based, list(DISTINCT label) AS labels, max(share) AS score FROM p GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(based), ','), '') AS base_labels, coalesce(array_to_string(list_sort(labels), ','), '') AS labels,
       coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN s USING (r)"""
