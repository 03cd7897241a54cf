"""Licence detection by ordered signature rules (operator 3, native).

A text becomes its words joined by single spaces. Rules are regular expressions over
that form, several hundred of them, written from a table of licences and the forms in
which a licence is named (identifier tag, notice, grant, reference, bare name), plus sentences of licence bodies and headers, and
general notices. Each rule has a gate of alternative sets of keywords, one for every form
of its pattern: it only runs where the document holds all of a set, so most documents run none. What the rules find are word intervals with a
priority. Containment resolves overlaps: an interval inside another one of the same or a better priority is suppressed (of equal
intervals the better priority, then the earlier rule stays); of what is left, an interval that holds one of a
strictly better priority is suppressed by it. Intervals that only cross both stay.

Beside the rules, the base phrases are counted at all their places.

Each step is linear in a text's words and matches: starts of matches are marked in the text, which is cut into words once for
each rule that matches, and both suppressions are sweeps that hold one number for each priority.

All work is done on arrays in the document's own row: no shuffle, no Python. Defined
cases: null and empty texts have no words and no labels; repeated documents are scanned
row by row; an empty table gives an empty result; other columns are kept by ``detect`` unless it names its own like them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import lower_ascii, pinned, table, words

#: Phrases counted at every place, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_L = "licen[cs]e"
_V = "(?: version| v)?"
#: label, whole words that must all occur (| between alternatives; license also stands for licence), identifier, name: over words
#: joined by spaces.
LICENSES = [
    ("apache-1.1", "apache", "apache 1 1", f"apache (?:software )?{_L}{_V} 1 1"),
    ("apache-2.0", "apache", "apache 2 0", f"apache (?:software )?{_L}{_V} 2(?: 0)?"),
    ("mit", "mit license|expat license", "mit", f"(?:mit|expat) {_L}"),
    ("mit-0", "mit license", "mit 0", f"mit no attribution {_L}"),
    ("x11", "x11 license", "x11", f"x11 {_L}"),
    ("isc", "isc license", "isc", f"isc {_L}"),
    ("bsd", "bsd license|berkeley license", "bsd", f"(?:berkeley software distribution|bsd) {_L}"),
    ("bsd-2-clause", "bsd|freebsd", "bsd 2 clause", f"(?:simplified bsd {_L}|freebsd {_L}|bsd 2 clause(?: {_L})?|2 clause bsd(?: {_L})?)"),
    ("bsd-3-clause", "bsd", "bsd 3 clause", f"(?:(?:new|modified|revised) bsd {_L}|bsd 3 clause(?: {_L})?|3 clause bsd(?: {_L})?)"),
    ("bsd-4-clause", "bsd", "bsd 4 clause", f"(?:original bsd {_L}|bsd 4 clause(?: {_L})?|4 clause bsd(?: {_L})?)"),
    ("0bsd", "0bsd|zero bsd", "0bsd", f"(?:zero clause bsd|0bsd)(?: {_L})?"),
    ("gpl-1.0", "gnu license", "gpl 1 0(?: only| or later)?", f"gnu general public {_L}{_V} 1(?: 0)?"),
    ("gpl-2.0", "gnu license", "gpl 2 0(?: only| or later)?", f"gnu general public {_L}{_V} 2(?: 0)?"),
    ("gpl-3.0", "gnu license", "gpl 3 0(?: only| or later)?", f"gnu general public {_L}{_V} 3(?: 0)?"),
    ("gpl-short", "gpl|gpl1|gpl2|gpl3|gplv1|gplv2|gplv3", "gpl", f"(?:gnu )?gpl(?: ?v?[123](?: 0)?)?"),
    ("gpl-any", "gnu license", "gpl any", f"gnu general public {_L}"),
    ("lgpl-2.0", "gnu license", "lgpl 2 0(?: only| or later)?", f"gnu library general public {_L}{_V} 2(?: 0)?"),
    ("lgpl-2.1", "gnu license", "lgpl 2 1(?: only| or later)?", f"gnu lesser general public {_L}{_V} 2 1"),
    ("lgpl-3.0", "gnu license", "lgpl 3 0(?: only| or later)?", f"gnu lesser general public {_L}{_V} 3(?: 0)?"),
    ("lgpl", "gnu license", "lgpl", f"gnu lesser general public {_L}"),
    ("agpl-3.0", "gnu license", "agpl 3 0(?: only| or later)?", f"gnu affero general public {_L}{_V} 3(?: 0)?"),
    ("agpl", "affero license", "agpl", f"(?:gnu )?affero general public {_L}"),
    ("gfdl-1.2", "gnu license", "gfdl 1 2(?: only| or later)?", f"gnu free documentation {_L}{_V} 1 2"),
    ("gfdl-1.3", "gnu license", "gfdl 1 3(?: only| or later)?", f"gnu free documentation {_L}{_V} 1 3"),
    ("mpl-1.1", "mozilla license", "mpl 1 1", f"mozilla public {_L}{_V} 1 1"),
    ("mpl-2.0", "mozilla license", "mpl 2 0", f"mozilla public {_L}{_V} 2(?: 0)?"),
    ("epl-1.0", "eclipse license", "epl 1 0", f"eclipse public {_L}{_V} 1(?: 0)?"),
    ("epl-2.0", "eclipse license", "epl 2 0", f"eclipse public {_L}{_V} 2(?: 0)?"),
    ("cddl-1.0", "cddl", "cddl 1 0", f"cddl(?: {_L})?(?:{_V} 1(?: 0)?)?"),
    ("eupl-1.2", "european license", "eupl 1 2", f"european union public {_L}(?:{_V} 1 2)?"),
    ("artistic-1.0", "artistic license", "artistic 1 0", f"artistic {_L}{_V} 1(?: 0)?"),
    ("artistic-2.0", "artistic license", "artistic 2 0", f"artistic {_L}{_V} 2(?: 0)?"),
    ("bsl-1.0", "boost license", "bsl 1 0", f"boost software {_L}(?:{_V} 1(?: 0)?)?"),
    ("zlib", "zlib license", "zlib", f"zlib(?: libpng)? {_L}"),
    ("unlicense", "unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl", f"wtfpl(?: {_L})?"),
    ("python-2.0", "python license", "(?:python|psf) 2 0", f"python(?: software foundation)? {_L}(?:{_V} 2(?: 0)?)?"),
    ("postgresql", "postgresql license", "postgresql", f"postgresql {_L}"),
    ("ofl-1.1", "font license", "ofl 1 1", f"(?:sil )?open font {_L}(?:{_V} 1 1)?"),
    ("odbl-1.0", "database license", "odbl 1 0", f"open (?:data commons open )?database {_L}(?:{_V} 1(?: 0)?)?"),
    ("cc0-1.0", "cc0", "cc0 1 0", "cc0(?: 1 0)?"),
    ("cc-by-2.0", "cc by", "cc by 2 0", "cc by 2 0"),
    ("cc-by-3.0", "cc by", "cc by 3 0", "cc by 3 0"),
    ("cc-by-4.0", "cc by", "cc by 4 0", "cc by 4 0"),
    ("cc-by-sa-3.0", "cc by sa", "cc by sa 3 0", "cc by sa 3 0"),
    ("cc-by-sa-4.0", "cc by sa", "cc by sa 4 0", "cc by sa(?: 4 0)?"),
    ("cc-by-nc-3.0", "cc by nc", "cc by nc 3 0", "cc by nc 3 0"),
    ("cc-by-nc-4.0", "cc by nc", "cc by nc 4 0", "cc by nc(?: 4 0)?"),
    ("cc-by-nd-4.0", "cc by nd", "cc by nd 4 0", "cc by nd(?: 4 0)?"),
    ("cc-by-nc-sa-4.0", "cc by nc sa", "cc by nc sa 4 0", "cc by nc sa(?: 4 0)?"),
    ("cc-by-nc-nd-4.0", "cc by nc nd", "cc by nc nd 4 0", "cc by nc nd(?: 4 0)?"),
    ("cc-by-long", "creative commons attribution", "cc by long",
     f"creative commons attribution(?: (?:noncommercial|non commercial|share ?alike|no ?deriv(?:ative)?s))*(?: \\d(?: \\d)?)?(?: (?:international|unported|generic))?(?: {_L})?"),
]

_THING = "(?:work|software|program|library|file|project|code|source code|document|dataset|data|text|content|package|font)"
_GIVEN = "(?:licensed|released|distributed|published|provided|available|made available|redistributed)"
_UNDER = "(?:under|subject to|pursuant to)(?: the)?(?: terms(?: and conditions)? of)?(?: the)?"
#: form, priority (1 is best), score, pattern around a licence's name.
FORMS = [
    ("tag", 1, 1.0, "spdx license identifier {id}"),
    ("notice", 2, 0.98, f"(?:this|the) {_THING} (?:is|are|may be|can be) {_GIVEN} {_UNDER} {{name}}"),
    ("grant", 3, 0.95, f"{_GIVEN} {_UNDER} {{name}}"),
    ("reference", 4, 0.85, "(?:see|read|refer to|a copy of|according to|in accordance with|covered by|governed by)(?: the)? {name}"),
    ("name", 5, 0.8, "{name}"),
]
#: label, keywords, pattern: notices that name no licence.
GENERAL = [
    ("all-rights-reserved", "rights reserved", "all rights reserved"),
    ("copyright-notice", "copyright", "copyright(?: c)?(?: by)? (?:19|20)\\d\\d(?: (?:19|20)\\d\\d)?"),
    ("public-domain", "public domain", "(?:in|into|to) the public domain"),
    ("public-domain", "public domain", "public domain (?:work|software|dedication|mark)"),
    ("proprietary", "proprietary", "proprietary and confidential"),
    ("proprietary", "proprietary", f"proprietary {_L}"),
    ("proprietary", "permission", "without (?:the )?(?:prior )?written permission"),
    ("permissive-text", "permission", "permission is hereby granted free of charge"),
    ("permissive-text", "permission", "permission to use copy modify and (?:or )?distribute"),
    ("bsd-text", "redistribution", "redistribution and use in source and binary forms"),
    ("warranty", "warranty", "without warranty of any kind"),
    ("warranty", "warranties", "without warranties or conditions of any kind"),
    ("non-commercial", "commercial|noncommercial", "for non ?commercial (?:use|purposes)(?: only)?"),
    ("license-file", "license", f"see the {_L} file"),
    ("end-user-license", "license", f"end user {_L} agreement"),
]

#: label, keywords, pattern: sentences of the licences themselves and of the headers that they ask for (fixed values).
BODIES = [
    ("mit", "permission granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "permission notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("bsl-1.0", "permission granted", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("isc", "permission granted", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "contributors endorse", "nor the names of (?:its|the) contributors may be used to endorse or promote products"),
    ("apache-2.0", "compliance license", f"you may not use this file except in compliance with the {_L}"),
    ("apache-2.0", "distributed license basis", f"software distributed under the {_L} is distributed on an as is basis"),
    ("apache-2.0", "contributor grants", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable"),
    ("gpl", "gnu foundation", f"gnu general public {_L} as published by the free software foundation"),
    ("lgpl", "gnu lesser foundation", f"gnu lesser general public {_L} as published by the free software foundation"),
    ("agpl", "gnu affero foundation", f"gnu affero general public {_L} as published by the free software foundation"),
    ("gpl", "received gnu", f"you should have received a copy of the gnu general public {_L}"),
    ("lgpl", "received gnu lesser", f"you should have received a copy of the gnu lesser general public {_L}"),
    ("agpl", "received gnu affero", f"you should have received a copy of the gnu affero general public {_L}"),
    ("gpl-2.0-or-later", "version later", f"either version 2 of the {_L} or at your option any later version"),
    ("gpl-3.0-or-later", "version later", f"either version 3 of the {_L} or at your option any later version"),
    ("gpl", "verbatim document", f"everyone is permitted to copy and distribute verbatim copies of this {_L} document but changing it is not allowed"),
    ("gpl", "implied merchantability", "without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("wtfpl", "verbatim modified document", f"everyone is permitted to copy and distribute verbatim or modified copies of this {_L} document"),
    ("mpl-2.0", "mozilla form", f"this source code form is subject to the terms of the mozilla public {_L}(?: v| version)? 2 0"),
    ("epl", "eclipse accompanying", f"the accompanying materials are made available under the terms of the eclipse public {_L}"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented"),
    ("zlib", "altered plainly", "altered source versions must be plainly marked as such"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("cc0-1.0", "waived neighboring", "waived all copyright and related or neighboring rights"),
    ("cc", "creativecommons view", f"to view a copy of this {_L} visit(?: http| https)?(?: www)? creativecommons org"),
    ("ofl-1.1", "sil font", f"this font software is licensed under the sil open font {_L}"),
    ("python-2.0", "python foundation", f"python software foundation {_L}(?: version 2)? (?:is|agreement)"),
]
BODY_PRIORITY, BODY_SCORE = 3, 0.9


def _gate(keys: str) -> list[list[str]]:
    return [way.split(" ") for way in keys.split("|")]


def rules() -> list[dict]:
    """All rules in order: name, label, priority, score, keywords, pattern."""
    out = []
    for form, priority, score, shape in FORMS:
        for label, keys, tag, name in LICENSES:
            gate = ("spdx " + tag.split(" ")[0].split("(")[0] if form == "tag" and "(?:python" not in tag else
                    "spdx" if form == "tag" else keys)
            body = shape.format(id=tag, name=f"(?:{name})")
            out.append({"rule": f"{label}/{form}", "label": label, "priority": priority, "score": score,
                        "gate": _gate(gate), "pattern": f"(?<![^ ]){body}(?![^ ])"})
    for k, (label, keys, body) in enumerate(BODIES):
        out.append({"rule": f"{label}/body{k}", "label": label, "priority": BODY_PRIORITY, "score": BODY_SCORE,
                    "gate": _gate(keys), "pattern": f"(?<![^ ])(?:{body})(?![^ ])"})
    for k, (label, keys, body) in enumerate(GENERAL):
        out.append({"rule": f"{label}/general{k}", "label": label, "priority": 6, "score": 0.4,
                    "gate": _gate(keys), "pattern": f"(?<![^ ])(?:{body})(?![^ ])"})
    return out


def _quoted(text: str) -> str:
    return "r'" + text + "'"


_FOUND = "struct<s:int,e:int,priority:int,rule:int,label:string,score:double>"
#: Stands before the first word of a match; no word holds it.
_MARK = "\\u0001"


def _detections(table_: list[dict]) -> str:
    """SQL: the word intervals of all rules whose keywords the document holds, from ``norm`` and ``_keys``."""
    listed = ",".join(
        f"named_struct('rule', {n}, 'label', '{r['label']}', 'priority', {r['priority']}, 'score', {r['score']}D, "
        f"'gate', array({','.join('array(' + ','.join(map(repr, way)) + ')' for way in r['gate'])}), 'pattern', {_quoted(r['pattern'])})"
        for n, r in enumerate(table_))
    # Matches begin and end with words: the k-th marked word is where the k-th match begins.
    places = f"""flatten(transform(filter(array(regexp_extract_all(norm, r.pattern, 0)), m -> size(m) > 0), m -> zip_with(m,
        transform(array(split(regexp_replace(norm, r.pattern, '{_MARK}$0'), ' ')), ws -> filter(
            transform(ws, (x, i) -> IF(startswith(x, '{_MARK}'), i, -1)), i -> i >= 0))[0],
        (got, at) -> struct(at AS at, size(split(got, ' ')) AS n))))"""
    return f"""CASE WHEN size(_keys) > 0 THEN flatten(transform(
        filter(array({listed}), r -> exists(r.gate, way -> forall(way, g -> array_contains(_keys, g)))),
        r -> transform({places}, x -> named_struct('s', x.at, 'e', x.at + x.n,
            'priority', r.priority, 'rule', r.rule, 'label', r.label, 'score', r.score))))
        ELSE CAST(array() AS array<{_FOUND}>) END"""


def _sweep(found: str, order: str, start: int, step: str, hit: str) -> str:
    """Those of ``found``, in ``order``, for which ``hit`` does not hold of the sweep's numbers ``a.at``, one for each priority.

    What a sweep carries on is copied at every step; so it carries a text of marks, not the list itself."""
    numbers = f"transform(sequence(0, coalesce(array_max(_all.priority), 0)), i -> {start})"
    marks = f"""aggregate(so, struct({numbers} AS at, '' AS marks),
        (a, x) -> struct(transform(a.at, (t, i) -> IF(i = x.priority, {step}(t, x.e), t)) AS at, concat(a.marks, IF({hit}, '-', '+')) AS marks),
        a -> a.marks)"""
    return f"""transform(array(transform(array_sort(transform({found}, d -> struct({order}, d AS d))), y -> y.d)),
        so -> filter(zip_with(so, split({marks}, ''), (x, mark) -> IF(mark = '+', x, NULL)), x -> x IS NOT NULL))[0]"""


#: First what lies inside an interval of the same or a better priority goes: with starts ascending, longer ones first, that is
#: whatever ends before the furthest end so far. Then what holds one of a better priority: with starts descending, shorter first,
#: that is whatever ends after the nearest end so far.
_NOT_INSIDE = _sweep("_all", "d.s AS s, -d.e AS e, d.priority AS priority, d.rule AS rule", -1, "greatest",
                     "exists(slice(a.at, 1, x.priority + 1), t -> t >= x.e)")
_RESOLVED = "array_sort(" + _sweep(f"({_NOT_INSIDE})", "-d.s AS s, d.e AS e, d.priority AS priority, d.rule AS rule", 2**31 - 1, "least",
                                   "exists(slice(a.at, 1, x.priority), t -> t <= x.e)") + ")"


def _base_places(phrase: str) -> str:
    parts = phrase.split(" ")
    here = " AND ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(parts))
    held = " AND ".join(f"array_contains(_keys, '{p}')" for p in parts)
    return (f"CASE WHEN size(w) >= {len(parts)} AND {held} THEN filter(sequence(0, size(w) - {len(parts)}), i -> {here}) "
            "ELSE CAST(array() AS array<int>) END")


def detect(docs: DataFrame, text_col: str = "text", rule_table: list[dict] | None = None) -> DataFrame:
    """``docs`` with ``n_words``, ``base`` (array of label, places) and ``detections`` (what the rules keep: s, e
    as a half-open range of words, priority, rule number, label, score)."""
    table_ = rule_table or rules()
    keywords = sorted({g for r in table_ for way in r["gate"] for g in way} | {p for b in BASE for p in b.split(" ")} | {"licence"})
    held = f"array_intersect(w, array({','.join(repr(k) for k in keywords)}))"
    scanned = pinned(docs.select(F.struct(*docs.columns).alias("_row")), "w", words(lower_ascii(F.col("_row").getField(text_col))))
    keyed = pinned(scanned, "_keys", F.expr(f"transform(array({held}), k -> IF(array_contains(k, 'licence'), array_union(k, array('license')), k))[0]"))
    gated = pinned(keyed, "norm", F.expr("IF(size(_keys) > 0, array_join(w, ' '), '')"))
    found = pinned(gated, "_all", F.expr(_detections(table_)))
    base = ",".join(f"struct('{label}' AS label, {_base_places(phrase)} AS places)" for phrase, label in BASE.items())
    return pinned(found, "base", F.expr(f"array({base})")).withColumns(
        {"n_words": F.size("w").cast("long"), "detections": F.expr(_RESOLVED)}).select(
        *(f"_row.`{c}`" for c in docs.columns if c not in ("n_words", "base", "detections")), "n_words", "base", "detections")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pinned(detect(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "places",
                   F.expr("flatten(base.places)"))
    base_labels = "transform(filter(base, b -> size(b.places) > 0), b -> b.label)"
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.expr(f"array_join(array_sort({base_labels}), ',')").alias("base_labels"),
        F.expr(f"array_join(array_sort(array_union({base_labels}, array_distinct(detections.label))), ',')").alias("labels"),
        F.expr("greatest(IF(size(places) > 0, 0.5D, 0.0D), coalesce(array_max(detections.score), 0.0D))").alias("score"))
