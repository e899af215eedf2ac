"""License scans by ordered signature rules, in DataFrame functions only.

Texts become lower-case words with single spaces. A rule is a regular expression over that form, gated by a keyword that
must stand in it; every expression is a literal, so it is compiled once for each task. Detections are intervals. Read from the
left, one that lies within another is suppressed, and of two that overlap otherwise the one whose rule comes first stays. The base phrases are always reported. Each text is worked on in its own row: nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm.common import table
from tidepanel.llm.native_spans import bound, matches

#: Fixed by contract: phrase and label.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


@dataclass(frozen=True)
class Rule:
    priority: int
    label: str
    keyword: str
    pattern: str
    confidence: float


#: Families of licenses: label, the name as words, short names, versions.
_FAMILIES = (
    ("gpl", "gnu general public license", ("gpl", "gnu gpl"), ("1", "2", "3")),
    ("lgpl", "gnu lesser general public license", ("lgpl", "gnu lgpl"), ("2", "2 1", "3")),
    ("lgpl", "gnu library general public license", ("gnu library gpl",), ("2",)),
    ("agpl", "gnu affero general public license", ("agpl", "gnu agpl"), ("1", "3")),
    ("gfdl", "gnu free documentation license", ("gfdl", "gnu fdl"), ("1 1", "1 2", "1 3")),
    ("apache", "apache license", ("apache", "asl"), ("1 0", "1 1", "2 0")),
    ("mit", "mit license", ("mit", "expat license"), ()),
    ("bsd", "bsd license", ("bsd",), ()),
    ("isc", "isc license", ("isc",), ()),
    ("mpl", "mozilla public license", ("mpl",), ("1 0", "1 1", "2 0")),
    ("epl", "eclipse public license", ("epl",), ("1 0", "2 0")),
    ("cddl", "common development and distribution license", ("cddl",), ("1 0", "1 1")),
    ("cpl", "common public license", ("cpl",), ("1 0",)),
    ("eupl", "european union public licence", ("eupl",), ("1 0", "1 1", "1 2")),
    ("osl", "open software license", ("osl",), ("1 0", "2 0", "2 1", "3 0")),
    ("afl", "academic free license", ("afl",), ("1 2", "2 0", "2 1", "3 0")),
    ("artistic", "artistic license", ("artistic",), ("1 0", "2 0")),
    ("boost", "boost software license", ("bsl",), ("1 0",)),
    ("zlib", "zlib license", ("zlib",), ()),
    ("psf", "python software foundation license", ("psf license", "python license"), ("2",)),
    ("openssl", "openssl license", (), ()),
    ("php", "php license", (), ("3 0", "3 01")),
    ("w3c", "w3c software notice and license", (), ()),
    ("unlicense", "unlicense", (), ()),
    ("wtfpl", "do what the fuck you want to public license", ("wtfpl",), ("2",)),
    ("ofl", "sil open font license", ("ofl",), ("1 0", "1 1")),
    ("sspl", "server side public license", ("sspl",), ("1",)),
    ("busl", "business source license", ("busl",), ("1 1",)),
    ("elastic", "elastic license", (), ("2 0",)),
    ("odbl", "open database license", ("odbl",), ("1 0",)),
    ("cecill", "cecill free software license agreement", ("cecill",), ("1 0", "2 0", "2 1")),
    ("mspl", "microsoft public license", ("ms pl",), ()),
    ("msrl", "microsoft reciprocal license", ("ms rl",), ()),
    ("postgresql", "postgresql license", (), ()),
    ("ncsa", "university of illinois ncsa open source license", (), ()),
    ("upl", "universal permissive license", ("upl",), ("1 0",)),
    ("vim", "vim license", (), ()),
    ("x11", "x11 license", (), ()),
)
_CC = (
    ("cc-by", "by", "attribution"), ("cc-by-sa", "by sa", "attribution sharealike"), ("cc-by-nd", "by nd", "attribution noderivatives"),
    ("cc-by-nc", "by nc", "attribution noncommercial"), ("cc-by-nc-sa", "by nc sa", "attribution noncommercial sharealike"),
    ("cc-by-nc-nd", "by nc nd", "attribution noncommercial noderivatives"),
)
#: Sentences of notices and grants: label, keyword, words.
_NOTICES = (
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "without restriction", "deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute"),
    ("isc", "permission to use", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3", "neither the name", "neither the name of( [^ ]+){1,12} nor the names of its contributors may be used to endorse or promote"),
    ("bsd-2", "this list of conditions", "redistributions of source code must retain the above copyright notice this list of conditions"),
    ("apache-2.0", "apache", "you may not use this file except in compliance with the license"),
    ("zlib", " as is ", "this software is provided as is without any express or implied warranty"),
    ("gpl", "free software", "this program is free software you can redistribute it and or modify it"),
    ("lgpl", "free software", "this library is free software you can redistribute it and or modify it"),
    ("mpl", "source code form", "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "public domain", "this is free and unencumbered software released into the public domain"),
    ("public-domain", "public domain", "(dedicated|released|placed|donated) (to|into|in) the public domain"),
    ("public-domain", "public domain", "this (work|file|code|document) is in the public domain"),
    ("cc0", "cc0", "cc0( 1 0)?( universal)?"),
    ("boost", "boost", "distributed under the boost software license"),
    ("proprietary", "confidential", "proprietary and confidential"),
    ("proprietary", "unauthorized", "unauthorized (copying|reproduction|distribution|use) of this (file|work|document|software|material)"),
    ("proprietary", "reproduced", "no part of this (publication|book|work|document) may be reproduced"),
    ("copyright", "copyright", "copyright( c)? (19|20)[0-9][0-9]( (19|20)[0-9][0-9])?( [^ ]+){1,3}"),
    ("copyright", "copyrighted", "copyrighted (material|work)"),
    ("trademark", "trademark", "(registered )?trademarks? of"),
    ("mit", "above copyright notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "to permit persons", "to permit persons to whom the software is furnished to do so"),
    ("mit", "mit style", "mit style license"),
    ("isc", "isc", "isc style license"),
    ("bsd", "bsd style", "bsd style license"),
    ("bsd", "reproduce the above copyright", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-4", "acknowledgement", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-0", "0bsd", "0bsd( license)?"),
    ("apache-2.0", "www apache org", "(https? )?www apache org licenses license 2 0"),
    ("apache-2.0", "apache", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache", "apache", "apache style license"),
    ("zlib", "altered source versions", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented"),
    ("gpl-2.0", "gnu", "either version 2 of the license or at your option any later version"),
    ("gpl-3.0", "gnu", "either version 3 of the license or at your option any later version"),
    ("gpl", "free software foundation", "as published by the free software foundation"),
    ("gpl", "copy of the gnu", "you should have received a copy of the gnu general public license"),
    ("lgpl", "copy of the gnu", "you should have received a copy of the gnu lesser general public license"),
    ("agpl", "copy of the gnu", "you should have received a copy of the gnu affero general public license"),
    ("gpl", "gpl compatible", "gpl compatible license"),
    ("gpl", "copyleft", "copyleft license"),
    ("mpl-2.0", "mozilla org", "(https? )?mozilla org mpl 2 0"),
    ("mpl", "covered code", "covered code under the terms of this license"),
    ("epl", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cddl", "cddl", "common development and distribution license the license"),
    ("boost", "www boost org", "(https? )?www boost org license 1 0 txt"),
    ("boost", "machine executable object code", "generated by a source language processor"),
    ("unlicense", "unlicense", "(https? )?(www )?unlicense org"),
    ("public-domain", "dedicate", "dedicate any and all copyright interest in the software to the public domain"),
    ("public-domain", "no copyright", "no copyright reserved"),
    ("public-domain", "public domain", "public domain (mark|dedication)( 1 0)?"),
    ("wtfpl", "what the fuck", "everyone is permitted to copy and distribute verbatim or modified copies of this license document"),
    ("beerware", "beer ware", "the beer ware license( revision 42)?"),
    ("artistic", "same terms as perl", "(under )?the same terms as perl itself"),
    ("psf", "python", "python software foundation license version 2"),
    ("openssl", "openssl", "this product includes software developed by the openssl project"),
    ("ijg", "independent jpeg group", "this software is based in part on the work of the independent jpeg group"),
    ("libpng", "libpng", "libpng license( version 2 0)?"),
    ("curl", "curl", "curl license"),
    ("icu", "unicode", "unicode license( v3)?"),
    ("json", "good not evil", "the software shall be used for good not evil"),
    ("ofl", "scripts sil org", "(https? )?scripts sil org ofl"),
    ("cc", "creativecommons org", "(https? )?(www )?creativecommons org licenses [a-z ]{2,8} [0-9] [0-9]"),
    ("cc0", "creativecommons org", "(https? )?(www )?creativecommons org publicdomain zero 1 0"),
    ("cc", "creative commons", "licensed under a creative commons [a-z ]{2,40} license"),
    ("cc", "some rights reserved", "some rights reserved"),
    ("polyform", "polyform", "polyform (noncommercial|small business|strict|shield|internal use|perimeter) license( 1 0 0)?"),
    ("commons-clause", "commons clause", "commons clause( license)?( condition)?( v ?1 0)?"),
    ("sspl", "mongodb", "server side public license as published by mongodb"),
    ("elastic", "elasticsearch", "licensed to elasticsearch( b v)?"),
    ("rail", " rail ", "open( and responsible)? ?rail( m)?( license)?"),
    ("llama", "community license", "llama( [0-9]){0,2} community license( agreement)?"),
    ("odc-by", "open data commons", "open data commons attribution license( v ?1 0)?"),
    ("pddl", "open data commons", "open data commons public domain dedication and license( pddl)?"),
    ("ogl", "open government", "open government licen[cs]e( v ?[0-9]( 0)?)?"),
    ("proprietary", "trade secret", "confidential and trade secret information"),
    ("proprietary", "internal use only", "for internal use only"),
    ("proprietary", "do not distribute", "do not (copy or )?distribute"),
    ("proprietary", "strictly prohibited", "is strictly prohibited without (the )?(prior )?written (consent|permission)"),
    ("proprietary", "end user license", "end user licen[cs]e agreement"),
    ("proprietary", "written permission", "without (the )?(express |prior |prior express )?written permission( of)?"),
    ("non-commercial", "commercial", "for (personal and |research and |academic and )?non ?commercial (use|purposes) only"),
    ("non-commercial", "not for commercial", "not for commercial (use|purposes|distribution)"),
    ("research", "research", "for research (purposes|use) only"),
    ("permission", "with permission", "(reprinted|reproduced|used) with( the)?( kind)? permission( of)?"),
    ("copyright", "all rights", "(c|copyright) [^ ]+( [^ ]+){0,4} all rights reserved"),
    ("copyright", "copyright", "copyright holders?"),
    ("trademark", "registered trademark", "is a( registered)? trademark of"),
    ("warranty", "warranty", "without (any )?warranty of any kind( express or implied)?"),
    ("warranty", "merchantability", "implied warranties of merchantability( and fitness for a particular purpose)?"),
)
#: Identifiers of tags whose names are not plain family and version: identifier as words, label.
_TAGS = (
    ("bsd 2 clause", "bsd-2"), ("bsd 3 clause", "bsd-3"), ("bsd 4 clause", "bsd-4"), ("bsd 2 clause patent", "bsd-2"), ("bsd 3 clause clear", "bsd-3"), ("0bsd", "bsd-0"), ("isc", "isc"), ("mit 0", "mit"),
    ("bsl 1 0", "boost-1.0"), ("cc0 1 0", "cc0"), ("python 2 0", "psf-2.0"), ("psf 2 0", "psf-2.0"), ("ncsa", "ncsa"), ("curl", "curl"), ("libpng 2 0", "libpng"), ("ijg", "ijg"), ("unicode 3 0", "icu"),
    ("json", "json"), ("beerware", "beerware"), ("odc by 1 0", "odc-by"), ("pddl 1 0", "pddl"), ("licenseref [^ ]+( proprietary)?", "proprietary"),
)


def _versioned(version: str) -> str:
    return rf"( v| version| v )? ?{version}" + ("" if " " in version else "( 0)?")


def _rules() -> tuple[Rule, ...]:
    """All signatures, most specific first; the order is the priority."""
    found: list[tuple[str, str, str, float]] = []
    for label, name, shorts, versions in _FAMILIES:
        for v in versions:
            tag = f"{label}-{v.replace(' ', '.')}" + ("" if " " in v else ".0")
            found.append((tag, name, f"(the )?{name}{_versioned(v)}( or( any)? later( version)?)?", 0.95))
            found += [(tag, f" {s} ", f"{s}{_versioned(v)}( only| or later)?", 0.85) for s in shorts]
            found.append((tag, "spdx", f"spdx license identifier {label} {v}( 0)?( only| or later)?", 1.0))
    found += [(label, "spdx", f"spdx license identifier {tag}", 1.0) for tag, label in _TAGS]
    for label, name, _, _ in _FAMILIES:
        found.append((label, name, f"(licensed|released|distributed|available|published) under( the terms of)? the {name}", 0.9))
        found.append((label, "spdx", f"spdx license identifier {label}( [0-9]+)*( clause| only| or later)*", 0.9))
    for label, mark, words in _CC:
        for v in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            found.append((f"{label}-{v.replace(' ', '.')}", " cc ", f"cc {mark} {v}", 0.95))
            found.append((f"{label}-{v.replace(' ', '.')}", "creative commons", f"creative commons {words} {v}( international| unported| generic)?( license)?", 0.95))
        found.append((label, " cc ", f"cc {mark}", 0.8))
        found.append((label, "creative commons", f"creative commons {words}( license)?", 0.85))
    found += [(label, keyword, words, 0.9) for label, keyword, words in _NOTICES]
    for label, name, shorts, _ in _FAMILIES:
        found.append((label, name, name, 0.7))
        found += [(label, f" {s} ", f"(licensed|released|distributed) under( the)? {s}( license)?", 0.7) for s in shorts]
    return tuple(Rule(i, label, keyword, f" {pattern} ", confidence) for i, (label, keyword, pattern, confidence) in enumerate(found))


def _more_rules(least: int) -> tuple[Rule, ...]:
    """Versions in one word with the name (``gplv2``) or without their zero (``mpl v2``), and clause counts of BSD. The keywords
    end within a word, so that each text that the pattern matches holds them."""
    found: list[tuple[str, str, str, float]] = []
    later = "( only| or( any)? later( version)?)?"
    for label, _, shorts, versions in _FAMILIES:
        for v in versions:
            tag = f"{label}-{v.replace(' ', '.')}" + ("" if " " in v else ".0")
            for s in shorts:
                found.append((tag, f" {s}", f"{s}( ?v ?| version | ?){v}" + ("" if " " in v else "( 0)?") + later, 0.85))
                if v.endswith(" 0"):  # a plain number after these words is often that of a program
                    lead = "( ?v ?| version )" if s in ("apache", "artistic") else "( ?v ?| version |)"
                    found.append((tag, f" {s}", f"{s}{lead}{v[:-2]}{later}", 0.85))
    for n, name in (("0", "zero"), ("1", "one"), ("2", "two"), ("3", "three"), ("4", "four")):
        found.append((f"bsd-{n}", " bsd ", f"bsd ({n}|{name}) ?clause( (new|revised|modified|simplified|original|clear))?( or [^ ]+)?( license)?", 0.9))
        found.append((f"bsd-{n}", " bsd ", f"({n}|{name}) ?clause bsd( license)?", 0.9))
    return tuple(Rule(least + i, label, keyword, f" {pattern} ", confidence) for i, (label, keyword, pattern, confidence) in enumerate(found))


RULES = _rules()
RULES += _more_rules(len(RULES))


def _coarse(keyword: str) -> str:
    """What a word of the keyword begins with: its longest word, all license words as one."""
    word = max(keyword.split(), key=len)
    return "licen" if word.startswith("licen") else word


def _gate(rules: tuple[Rule, ...]) -> dict[str, list[str]]:
    """Beginnings of words, none the beginning of another, with the keywords that need them."""
    kept: dict[str, list[str]] = {}
    for keyword in sorted({r.keyword for r in rules}, key=lambda k: (len(_coarse(k)), k)):
        start = next((k for k in kept if _coarse(keyword).startswith(k)), _coarse(keyword))
        kept.setdefault(start, []).append(keyword)
    return kept


def _any_of(words: list[str]) -> str:
    """A regular expression for any of some words, branched by their letters."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    parts = [h + (_any_of(rest) if any(rest) else "") for h, rest in sorted(heads.items())]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


_SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    """The words, A-Z in lower case, with a space before and after each; empty if there is none.

    Other letters may change case too, which no rule sees, but for the two whose lower case is an ASCII letter.
    """
    plain = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138")), F.lit("\u0130"), F.lit("\u0131"))
    trimmed = F.trim(F.regexp_replace(F.lower(plain), _SEPARATOR, " "))
    return F.when(trimmed == "", F.lit("")).otherwise(F.concat(F.lit(" "), trimmed, F.lit(" ")))


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


_HIT = "struct<start:bigint,end:bigint,priority:int,label:string,confidence:double>"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matching(words: str, starts: str, rules: tuple[Rule, ...]) -> Column:
    """Numbers of the rules that match the column ``words``, whose beginnings of words are the array ``starts``.

    Rules of one keyword are tried only where it stands. It is one SQL text, as there are hundreds of rules.
    """
    by_keyword: dict[str, list[str]] = {}
    for i, r in enumerate(rules):
        by_keyword.setdefault(r.keyword, []).append(f"CASE WHEN {words} RLIKE {_quoted(r.pattern)} THEN {i} END")
    tried = {k: f"CASE WHEN contains({words}, {_quoted(k)}) THEN array({', '.join(own)}) END" for k, own in by_keyword.items()}
    gated = (f"CASE WHEN array_contains({starts}, {_quoted(' ' + g)}) THEN array_compact(array({', '.join(tried[k] for k in keys)})) END" for g, keys in _gate(rules).items())
    return F.expr(f"array_compact(flatten(flatten(array_compact(array({', '.join(gated)})))))")


def _listed(rules: tuple[Rule, ...]) -> Column:
    """All rules as one constant array."""
    return F.expr("array(" + ", ".join(f"named_struct('priority', {r.priority}, 'label', {_quoted(r.label)}, 'confidence', {r.confidence}D, 'pattern', {_quoted(r.pattern)})" for r in rules) + ")")


def _kept(hits: Column) -> Column:
    """(labels, best confidence) of sorted detections after suppression, in one walk from the left."""
    def struct(current: Column, labels: Column, best: Column) -> Column:
        return F.struct(current.alias("current"), labels.alias("labels"), best.alias("best"))

    start = struct(F.lit(None).cast(_HIT), F.array().cast("array<string>"), F.lit(0.0))

    def emitted(state: Column) -> tuple[Column, Column]:
        return F.array_union(state["labels"], F.array(state["current"]["label"])), F.greatest(state["best"], state["current"]["confidence"])

    def step(state: Column, hit: Column) -> Column:
        now = state["current"]
        better = (hit["end"] > now["end"]) & (hit["priority"] < now["priority"])
        # the space at the end of one may begin the next
        apart = hit["start"] >= now["end"] - 1
        return (
            F.when(now.isNull(), struct(hit, state["labels"], state["best"])).when(apart, struct(hit, *emitted(state)))
            .when(better, struct(hit, state["labels"], state["best"])).otherwise(state)
        )

    def done(state: Column) -> Column:
        labels, best = emitted(state)
        return F.when(state["current"].isNull(), F.struct(state["labels"].alias("labels"), state["best"].alias("best"))).otherwise(F.struct(labels.alias("labels"), best.alias("best")))

    return F.aggregate(hits, start, step, done)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows (id, n_words, n_base, first_word, last_word, base_labels, labels, score), one for each row of ``docs``.

    Base phrases are counted at all their places; ``labels`` adds those of detections that no other suppresses. ``score`` is the
    highest confidence of a detection, 0.5 for a base phrase alone and 0 for none. Null and empty texts have no words. Ids may
    be null or repeat, and rows with equal texts have equal results. Very long texts are scanned whole. An empty table gives no
    rows; other columns are not read, so their names can't clash.
    """
    rows = docs.select(F.col(id_col).alias("id"), _words(F.col(text_col)).alias("words"))
    places = {}
    for phrase, label in BASE:
        size = phrase.count(" ") + 1
        pieces = F.split(F.col("words"), f" {phrase}(?= )")
        count = F.size(pieces) - 1
        first = _spaces(F.element_at(pieces, 1))
        last = _spaces(F.col("words")) - _spaces(F.element_at(pieces, -1)) - size
        # the last piece begins with the space that follows the phrase
        places[label] = F.when(F.contains("words", F.lit(f" {phrase} ")), F.struct(count.cast("long").alias("n"), first.alias("first"), last.alias("last")))
    gate = " " + _any_of(sorted(_gate(rules)))
    # the generator keeps Spark from computing the words anew for each of their uses
    rows = rows.select("id", F.explode(F.array("words")).alias("words"))
    rows = rows.select("id", F.greatest(_spaces(F.col("words")) - 1, F.lit(0).cast("long")).alias("n_words"), *(c.alias(k) for k, c in places.items()), "words", F.array_distinct(F.regexp_extract_all("words", F.lit(gate), F.lit(0))).alias("starts"))

    def places_of(i: Column) -> Column:
        return bound(F.get(_listed(rules), i), places_of_rule)

    def places_of_rule(rule: Column) -> Column:
        return F.transform(matches(F.col("words"), rule["pattern"]), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["confidence"].alias("confidence")))

    found = bound(F.when(F.size("starts") > 0, _matching("words", "starts", rules)), lambda r: F.when(F.size(r) > 0, _kept(F.array_sort(F.flatten(F.transform(r, places_of)), _before))))
    out = rows.withColumn("found", found)
    base = F.array_sort(F.array_compact(F.array(*(F.when(F.col(f"`{label}`").isNotNull(), F.lit(label)) for _, label in BASE))))
    n = sum((F.coalesce(F.col(f"`{label}`.n"), F.lit(0).cast("long")) for _, label in BASE), F.lit(0).cast("long"))
    more = F.coalesce("found.labels", F.array().cast("array<string>"))
    firsts, lasts = ([F.col(f"`{label}`.{k}") for _, label in BASE] for k in ("first", "last"))
    return out.select(
        "id", "n_words", n.alias("n_base"), F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base, more)), ",").alias("labels"),
        F.greatest(F.coalesce("found.best", F.lit(0.0)), F.when(n > 0, F.lit(0.5)).otherwise(F.lit(0.0))).alias("score"))


def _before(a: Column, b: Column) -> Column:
    """Order of detections: by start, the longer first, then by rule."""
    def order(x: Column, y: Column, after: Column) -> Column:
        return F.when(x < y, -1).when(x > y, 1).otherwise(after)

    return order(a["start"], b["start"], order(b["end"], a["end"], order(a["priority"], b["priority"], F.lit(0))))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document; nulls, ties, repeats, long texts and empty tables as in ``scan_licenses``."""
    return scan_licenses(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def _oracle() -> str:
    rules = ", ".join(f"({r.priority}, '{r.label}', '{r.keyword}', '{r.pattern}', {r.confidence})" for r in RULES)
    # doubled spaces let phrases follow each other without sharing one
    base = " UNION ALL ".join(
        f"SELECT doc_id, '{label}' AS label, {phrase.count(' ') + 1} AS size, n AS total, string_split(replace(w, ' ', '  '), '{''.join(f' {x} ' for x in phrase.split())}') AS p FROM d WHERE contains(w, ' {phrase} ')"
        for phrase, label in BASE)
    return f"""
WITH t AS (SELECT doc_id, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' ') AS s FROM documents),
d AS (SELECT doc_id, CASE WHEN s = '' THEN '' ELSE ' ' || s || ' ' END AS w, CASE WHEN s = '' THEN 0 ELSE len(string_split(s, ' ')) END AS n FROM t),
r(priority, label, keyword, pattern, confidence) AS (VALUES {rules}),
x AS (SELECT doc_id, priority, label, confidence, string_split(regexp_replace(w, pattern, chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS p
  FROM d JOIN r ON contains(w, keyword) WHERE regexp_matches(w, pattern)),
y AS (SELECT doc_id, priority, label, confidence, list_sum(list_transform(p[1:i - 1], lambda z: length(z)))::BIGINT - (i - 2) AS b, length(string_split(p[i], chr(2))[1]) AS k
  FROM x, unnest(range(2, len(p) + 1)) AS u(i)),
z AS (SELECT doc_id, list({{'s': b, 'e': b + k, 'r': priority, 'l': label, 'c': confidence, 'd': []::VARCHAR[], 'm': 0.0::DOUBLE}} ORDER BY b, b + k DESC, priority) AS h FROM y GROUP BY 1),
w AS (SELECT doc_id, list_reduce(h, lambda a, x: CASE WHEN x.s >= a.e - 1 THEN {{'s': x.s, 'e': x.e, 'r': x.r, 'l': x.l, 'c': x.c, 'd': list_append(a.d, a.l), 'm': greatest(a.m, a.c)}}
  WHEN x.e > a.e AND x.r < a.r THEN {{'s': x.s, 'e': x.e, 'r': x.r, 'l': x.l, 'c': x.c, 'd': a.d, 'm': a.m}} ELSE a END) AS f FROM z),
more AS (SELECT doc_id, list_append(f.d, f.l) AS labels, greatest(f.m, f.c) AS best FROM w),
p AS ({base}),
q AS (SELECT doc_id, label, len(p) - 1 AS n, (length(p[1]) - length(replace(p[1], ' ', ''))) // 2 AS f,
  total - (length(p[len(p)]) - length(replace(p[len(p)], ' ', ''))) // 2 - size AS l FROM p),
b AS (SELECT doc_id, sum(n)::BIGINT AS n, min(f) AS f, max(l) AS l, list(label) AS labels FROM q GROUP BY 1)
SELECT d.doc_id, d.n AS n_words, coalesce(b.n, 0) AS n_base, b.f AS first_word, b.l AS last_word,
  array_to_string(list_sort(coalesce(b.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(more.labels, [])))), ',') AS labels,
  greatest(coalesce(best, 0), CASE WHEN coalesce(b.n, 0) > 0 THEN 0.5 ELSE 0 END)::DOUBLE AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN more USING (doc_id)
"""


ORACLE = _oracle()
