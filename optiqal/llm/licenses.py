"""License scans by ordered signature rules, in columns only.

A text becomes its words with single blanks between them. Rules are regexes over that string: statements, in which a license
is named, made of names and forms, and signatures, wording of the licenses' own grants, notices and headers. A rule is tried
only on texts that hold its keyword, and none is tried on a text without any word that statements or signatures have.

SPDX expressions give a detection for each operand, "or later" has labels of its own, and a statement that
a text is not under a license hides the detections inside it.

Of the detections, one that lies inside another is dropped (of two at one place the one of higher priority stays). The rest is
gone through by priority, then start: one that overlaps a detection kept before, under another label, is dropped. What is left
after the first step is in order of both starts and ends, so each step looks only at the nearest detection kept on either side
and the nearest under another label: the work grows with the number of detections, not its square.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The phrases whose places are counted, and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: label, keyword (part of every text on which the rules are tried), regex of the name without "license" (as words).
FAMILIES = (
    ("mit", "mit", "mit(?: x11| expat)?"),
    ("mit-0", "mit", "mit (?:no attribution|0)"),
    ("x11", "x11", "x11"),
    ("apache-2", "apache", "apache(?: software)?(?: license)?(?: version| v)? ?2(?: 0)?"),
    ("apache-1.1", "apache", "apache(?: software)?(?: license)?(?: version| v)? ?1 1"),
    ("gpl-3.0", "general public", "(?:gnu )?general public license(?: version| v)? ?3(?: 0)?"),
    ("gpl-2.0", "general public", "(?:gnu )?general public license(?: version| v)? ?2(?: 0)?"),
    ("gpl-3.0", "gpl", "(?:gnu )?gpl ?(?:version |v)?3(?: 0)?"),
    ("gpl-2.0", "gpl", "(?:gnu )?gpl ?(?:version |v)?2(?: 0)?"),
    ("lgpl-3.0", "lesser general", "(?:gnu )?lesser general public license(?: version| v)? ?3(?: 0)?"),
    ("lgpl-2.1", "lesser general", "(?:gnu )?lesser general public license(?: version| v)? ?2 1"),
    ("lgpl-3.0", "lgpl", "(?:gnu )?lgpl ?(?:version |v)?3(?: 0)?"),
    ("lgpl-2.1", "lgpl", "(?:gnu )?lgpl ?(?:version |v)?2 1"),
    ("agpl-3.0", "affero", "(?:gnu )?affero general public license(?: version| v)? ?3(?: 0)?"),
    ("agpl-3.0", "agpl", "(?:gnu )?agpl ?(?:version |v)?3(?: 0)?"),
    ("gfdl-1.3", "documentation", "(?:gnu )?free documentation license(?: version| v)? ?1 3"),
    ("bsd-2", "bsd", "(?:simplified bsd|2 clause bsd|bsd 2 clause)"),
    ("bsd-3", "bsd", "(?:new bsd|modified bsd|revised bsd|3 clause bsd|bsd 3 clause)"),
    ("bsd-4", "bsd", "(?:original bsd|4 clause bsd|bsd 4 clause)"),
    ("bsd-0", "bsd", "(?:zero clause bsd|0 clause bsd|0bsd)"),
    ("isc", "isc", "isc"),
    ("zlib", "zlib", "zlib(?: libpng)?"),
    ("mpl-2.0", "mozilla", "mozilla public license(?: version| v)? ?2(?: 0)?"),
    ("mpl-1.1", "mozilla", "mozilla public license(?: version| v)? ?1 1"),
    ("mpl-2.0", "mpl", "mpl ?(?:version |v)?2(?: 0)?"),
    ("epl-2.0", "eclipse", "eclipse public license(?: version| v)? ?2(?: 0)?"),
    ("epl-1.0", "eclipse", "eclipse public license(?: version| v)? ?1(?: 0)?"),
    ("cddl-1.0", "common development", "common development and distribution license(?: version| v)? ?1(?: 0)?"),
    ("eupl-1.2", "eupl", "eupl(?: version| v)? ?1 2"),
    ("eupl-1.2", "european union", "european union public licen[cs]e(?: version| v)? ?1 2"),
    ("artistic-2.0", "artistic", "artistic license(?: version| v)? ?2(?: 0)?"),
    ("bsl-1.0", "boost", "boost software license(?: version| v)? ?1(?: 0)?"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("ofl-1.1", "open font", "(?:sil )?open font license(?: version| v)? ?1 1"),
    ("psf-2", "python", "python(?: software foundation)? license(?: version| v)? ?2(?: 0)?"),
    ("postgresql", "postgresql", "postgresql"),
    ("ncsa", "illinois", "university of illinois ncsa(?: open source)?"),
    ("ms-pl", "microsoft", "microsoft public"),
    ("odbl-1.0", "open database", "open database license(?: version| v)? ?1(?: 0)?"),
    ("odc-by-1.0", "open data commons", "open data commons attribution(?: license)?(?: v)? ?1(?: 0)?"),
    ("pddl-1.0", "public domain dedication", "open data commons public domain dedication(?: and license)?"),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc0-1.0", "creative commons", "creative commons (?:zero|cc0|0)(?: v1 0| 1 0)?(?: universal)?"),
    *((f"cc-{kind}", f"cc {kind.split('-')[0]}", "cc " + kind.replace("-", " ") + "(?: [1-4] [05])?") for kind in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")),
    *((f"cc-{kind}", "creative commons", f"creative commons {words}(?: [1-4] [05])?(?: international| unported)?") for kind, words in (("by", "attribution"), ("by-sa", "attribution share ?alike"), ("by-nd", "attribution no ?deriv(?:ative|s|atives)"), ("by-nc", "attribution non ?commercial"), ("by-nc-sa", "attribution non ?commercial share ?alike"), ("by-nc-nd", "attribution non ?commercial no ?deriv(?:ative|s|atives)"))),
)

#: After the name of a GNU license; the label then ends in "-or-later".
LATER = "(?: or later| or any later version| or at your option any later version)"
GNU = ("gpl-", "lgpl-", "agpl-", "gfdl-")
NAMES = "|".join(dict.fromkeys(name for _, _, name in FAMILIES))
#: An operand of an SPDX expression (brackets are no words), and an expression of several.
OPERAND = f"(?:{NAMES}|licenseref(?: [^ ]+){{1,4}}?)(?: only|{LATER})?(?: with(?: [^ ]+){{1,4}}? (?:exception|note)(?: [0-9]){{0,2}})?"
EXPRESSION = f"(?<= )spdx license identifier {OPERAND}(?: (?:and|or) {OPERAND})+(?= )"

#: Words before "under", and words before "under" or "by", in the forms below.
GIVEN = ("licensed", "released", "distributed", "published", "available", "provided", "made available")
RULED = ("use", "used", "governed", "covered")
#: How a text states a license, with {} for its name: regex, priority (1 first) and how sure it is.
FORMS = (
    ("spdx license identifier {}", 1, 1.0),
    (f"(?:is |are )?(?:dual )?(?:{'|'.join(GIVEN)}) under " "(?:the )?(?:terms of )?(?:the )?(?:conditions of )?(?:the )?{}(?: licen[sc]e)?", 2, 0.95),
    ("subject to (?:the )?(?:terms of )?(?:the )?{}(?: licen[sc]e)?", 3, 0.9),
    (f"(?:{'|'.join(RULED)}) " "(?:of this \\S+ is governed )?(?:under|by) (?:the )?(?:terms of )?(?:the )?{}(?: licen[sc]e)?", 3, 0.9),
    ("licen[sc]e {}", 4, 0.8),
    ("(?:the )?{} licen[sc]e", 5, 0.7),
)
#: What denies a statement, and the statement denied.
DENIALS = ("not", "never", "no longer", "isn t", "aren t")
DENIED = f"(?: be| been| being)?(?: now| currently)?(?: dual)?(?:(?: (?:{'|'.join([*GIVEN, *RULED])}))? (?:under|by)| subject to)(?: the)?(?: terms of| conditions of| terms and conditions of)?(?: the)? (?:{NAMES}){LATER}?(?: licen[sc]e)?"
#: Words of which every text that a form accepts holds one; on others no rule is tried.
KEYWORDS = ("licen", "spdx", "subject to", *(f"{x} under" for x in GIVEN), *(f"{x} {y}" for x in RULED for y in ("under", "by")))

#: Wording of licenses: label, keyword, regex, priority and how sure it is. The keywords pass the gate too. Where a holder is
#: named inside (`.{1,120}?`), the name has up to 120 characters.
SIGNATURES = (
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software(?: and associated documentation files)?", 2, 0.95),
    ("mit", "substantial portions", "the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software", 3, 0.85),
    ("mit-0", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so (?=the software is provided)", 1, 0.95),
    ("bsl-1.0", "permission is hereby granted", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", 2, 0.95),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?", 4, 0.85),
    ("bsd-3", "endorse or promote", "neither the names? of .{1,120}? (?:nor the names of (?:its|the|their) contributors )?may be used to endorse or promote products derived from this software without specific prior written permission", 2, 0.9),
    ("bsd-4", "advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 1, 0.95),
    ("isc", "with or without fee", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice", 2, 0.95),
    ("bsd-0", "with or without fee", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted(?! provided)", 2, 0.95),
    ("apache-2", "apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", 1, 1.0),
    ("apache-2", "www apache org", "(?:http |https )?www apache org licenses license 2 0", 3, 0.9),
    ("apache-1.1", "apache software foundation", "this product includes software developed by the apache software foundation http www apache org", 3, 0.8),
    ("gpl-3.0", "free software foundation", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", 1, 1.0),
    ("gpl-2.0", "free software foundation", "under the terms of the gnu general public license as published by the free software foundation (?:either )?version 2(?: of the license)?", 1, 1.0),
    ("lgpl-3.0", "free software foundation", "under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license", 1, 1.0),
    ("lgpl-2.1", "free software foundation", "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license", 1, 1.0),
    ("agpl-3.0", "free software foundation", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", 1, 1.0),
    ("gfdl-1.3", "permission is granted to copy", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 3", 1, 1.0),
    ("gpl-3.0-or-later", "free software foundation", f"under the terms of the gnu general public license as published by the free software foundation either version 3 of the license{LATER}", 1, 1.0),
    ("gpl-2.0-or-later", "free software foundation", f"under the terms of the gnu general public license as published by the free software foundation (?:either )?version 2(?: of the license)?{LATER}", 1, 1.0),
    ("lgpl-3.0-or-later", "free software foundation", f"under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license{LATER}", 1, 1.0),
    ("lgpl-2.1-or-later", "free software foundation", f"under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license{LATER}", 1, 1.0),
    ("agpl-3.0-or-later", "free software foundation", f"under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license{LATER}", 1, 1.0),
    ("gpl-3.0", "29 june 2007", "(?:gnu )?general public license version 3 29 june 2007", 1, 1.0),
    ("gpl-2.0", "june 1991", "(?:gnu )?general public license version 2 june 1991", 1, 1.0),
    ("lgpl-3.0", "29 june 2007", "(?:gnu )?lesser general public license version 3 29 june 2007", 1, 1.0),
    ("lgpl-2.1", "february 1999", "(?:gnu )?lesser general public license version 2 1 february 1999", 1, 1.0),
    ("agpl-3.0", "november 2007", "(?:gnu )?affero general public license version 3 19 november 2007", 1, 1.0),
    ("gfdl-1.3", "november 2008", "(?:gnu )?free documentation license version 1 3 3 november 2008", 1, 1.0),
    ("apache-2", "january 2004", "apache license version 2 0 january 2004", 1, 1.0),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0", 1, 1.0),
    ("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 1", 1, 1.0),
    ("epl-2.0", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license(?: v)? 2 0", 1, 1.0),
    ("epl-1.0", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0", 1, 1.0),
    ("cddl-1.0", "common development", "the contents of this file are subject to the terms of the common development and distribution license", 2, 0.9),
    ("unlicense", "unencumbered software", "this is free and unencumbered software released into the public domain", 1, 1.0),
    ("zlib", "express or implied warranty", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", 2, 0.95),
    ("zlib", "altered source versions", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 3, 0.9),
    ("wtfpl", "do what the", "do what the f\\S+ you want to public license", 1, 1.0),
    ("ncsa", "deal with the software", "deal with the software without restriction including without limitation", 3, 0.85),
    ("postgresql", "without a written agreement", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 1, 1.0),
    ("psf-2", "python software foundation", "psf hereby grants licensee a nonexclusive royalty free world wide license", 2, 0.9),
    ("artistic-2.0", "artistic", "this is free software licensed under the artistic license 2 0", 1, 1.0),
    ("ofl-1.1", "open font", "this font software is licensed under the sil open font license version 1 1", 1, 1.0),
    ("cc0-1.0", "extent possible under law", "to the extent possible under law .{1,120}? has waived all copyright and related or neighboring rights", 2, 0.95),
    ("cc0-1.0", "waived all copyright", "has waived all copyright and related or neighboring rights", 3, 0.9),
    ("cc-by-4.0", "creativecommons org", "creativecommons org licenses by 4 0", 2, 0.95),
    ("cc-by-sa-4.0", "creativecommons org", "creativecommons org licenses by sa 4 0", 2, 0.95),
    ("cc-by-sa-3.0", "creativecommons org", "creativecommons org licenses by sa 3 0", 2, 0.95),
    ("cc-by-nc-4.0", "creativecommons org", "creativecommons org licenses by nc 4 0", 2, 0.95),
    ("cc-by-nc-sa-4.0", "creativecommons org", "creativecommons org licenses by nc sa 4 0", 2, 0.95),
    ("cc-by-nd-4.0", "creativecommons org", "creativecommons org licenses by nd 4 0", 2, 0.95),
    ("cc-by-nc-nd-4.0", "creativecommons org", "creativecommons org licenses by nc nd 4 0", 2, 0.95),
    ("cc0-1.0", "creativecommons org", "creativecommons org publicdomain zero 1 0", 2, 0.95),
)

_RULE = "array<struct<pattern:string,label:string,priority:int,sure:double>>"
_RULES = f"array<struct<keyword:string,rules:{_RULE}>>"
_SPAN = "array<struct<start:int,len:int,priority:int,label:string,sure:double>>"
_PLACED = "array<struct<start:int,shorter:int,priority:int,label:string,sure:double>>"
#: Put before the first word of a match; no word holds it.
_MARK = "\x01"
#: Detections that a pass appends one by one before it appends them together; any number gives the same rows.
_CHUNK = 256


def _later() -> list[tuple[str, str, str]]:
    return [(f"{label}-or-later", kw, f"(?:{name}){LATER}") for label, kw, name in FAMILIES if label.startswith(GNU)]


def operands() -> list[dict]:
    """Rules for what stands in SPDX expressions."""
    return [{"pattern": f"(?<= )(?:{name})(?= )", "label": label, "priority": 1, "sure": 1.0} for label, _, name in [*FAMILIES, *_later()]]


def rules() -> list[dict]:
    """Every family in every form, denials (no label) and the signatures: pattern, label, keyword, priority and how sure it is, by priority."""
    families = [*FAMILIES, *_later()]
    made = [(kw, form.replace("{}", f"(?:{name})"), label, p, sure) for label, kw, name in families for form, p, sure in FORMS]
    made += [(no, no + DENIED, "", 1, 0.0) for no in DENIALS]
    made += [(kw, wording, label, p, sure) for label, kw, wording, p, sure in SIGNATURES]
    out = [{"keyword": kw, "pattern": f"(?<= )(?:{pattern})(?= )", "label": label, "priority": p, "sure": sure} for kw, pattern, label, p, sure in made]
    return sorted(out, key=lambda r: (r["priority"], r["label"], r["pattern"]))


def gates() -> list[str]:
    """Words of which every text that some rule accepts holds one."""
    return list(dict.fromkeys([*KEYWORDS, *(kw for _, kw, _, _, _ in SIGNATURES)]))


def words(text: Column) -> Column:
    """A-Z lower-cased, and every run of characters that are part of no word made one blank; a blank before and after."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), F.lit(" "))


def _blanks(x: Column) -> Column:
    return (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))).cast("int")


def _spans(line: Column, pattern: Column, priority: Column, label: Column, sure: Column) -> Column:
    """Where the pattern matches: first word and number of words, from the pieces between the matches."""
    hits = F.regexp_extract_all(line, pattern, F.lit(0))
    marked = F.split(F.regexp_replace(line, pattern, F.concat(F.lit(_MARK), F.lit("$0"))), F.lit(" "))
    at = F.filter(F.transform(marked, lambda w, i: F.when(F.startswith(w, F.lit(_MARK)), i)), lambda i: i.isNotNull())
    one = lambda x: F.struct((x["at"] - 1).alias("start"), (_blanks(x["hit"]) + 1).alias("len"), priority.alias("priority"), label.alias("label"), sure.alias("sure"))
    return F.transform(F.arrays_zip(at.alias("at"), hits.alias("hit")), one)


def _by_rules(line: Column, tried: Column) -> Column:
    return F.flatten(F.transform(tried, lambda r: _spans(line, r["pattern"], r["priority"], r["label"], r["sure"])))


def _in_expressions(line: Column) -> Column:
    """The operands of the line's SPDX expressions."""
    found = F.arrays_zip(_spans(line, F.lit(EXPRESSION), F.lit(1), F.lit(""), F.lit(1.0)).alias("span"), F.regexp_extract_all(line, F.lit(EXPRESSION), F.lit(0)).alias("hit"))
    table = F.from_json(F.lit(json.dumps(operands())), _RULE)

    def moved(e: Column) -> Column:
        inside = _by_rules(F.concat(F.lit(" "), e["hit"], F.lit(" ")), table)
        return F.transform(inside, lambda s: F.struct((s["start"] + e["span"]["start"]).alias("start"), *[s[c].alias(c) for c in ("len", "priority", "label", "sure")]))

    return F.when(F.contains(line, F.lit("spdx license identifier")), F.flatten(F.transform(found, moved))).otherwise(F.array().cast(_SPAN))


def _let(value: Column, made: Callable[[Column], Column]) -> Column:
    """made(value), with the value worked out once."""
    return F.transform(F.array(value), made)[0]


def _sift(items: Column, state: Column, keep: Callable[[Column, Column], Column], after: Callable[[Column, Column], Column]) -> Column:
    """The items for which keep(state, item) holds, in order; after(state, item) is the state that a kept item leaves."""
    none = F.array().cast(_PLACED)

    def one(s: Column, x: Column) -> Column:
        return F.when(keep(s["state"], x), F.struct(after(s["state"], x).alias("state"), F.concat(s["done"], F.array(x)).alias("done"))).otherwise(s)

    def every(x: Column) -> Column:
        def chunk(s: Column, at: Column) -> Column:
            start = F.struct(s["state"].alias("state"), none.alias("done"))
            return F.aggregate(F.slice(x, at, _CHUNK), start, one, lambda r: F.struct(r["state"].alias("state"), F.concat(s["chunks"], F.array(r["done"])).alias("chunks")))

        start = F.struct(state.alias("state"), F.array().cast(f"array<{_PLACED}>").alias("chunks"))
        return F.when(F.size(x) > 0, F.aggregate(F.sequence(F.lit(1), F.size(x), F.lit(_CHUNK)), start, chunk, lambda r: F.flatten(r["chunks"]))).otherwise(none)

    return _let(items, every)


def _end(x: Column) -> Column:
    return x["start"] - x["shorter"]


def _limit(s: Column, x: Column) -> Column:
    """How far the detections passed, of other labels than x, reach."""
    return F.when(x["label"] == s["label"], s["far"]).otherwise(s["near"])


def _resolved(spans: Column) -> Column:
    """Without detections inside others, and of two that overlap under different labels only the one of higher priority."""
    by_place = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["len"]).alias("shorter"), s["priority"].alias("priority"), s["label"].alias("label"), s["sure"].alias("sure"))))
    # one that begins before, or there and is longer or of higher priority, ends later
    outermost = _sift(by_place, F.lit(-1), lambda end, x: _end(x) > end, lambda _, x: _end(x))

    def level(items: Column, p: int, first: int, reach: Callable[[Column], Column], clear: Callable[[Column, Column], Column], decided: int) -> Column:
        """Without those of priority p that meet one of priority up to `decided` passed before, under another label."""
        state = F.struct(F.lit(None).cast("string").alias("label"), F.lit(first).alias("near"), F.lit(first).alias("far"))
        passed = lambda s, x: F.struct(x["label"].alias("label"), reach(x).alias("near"), _limit(s, x).alias("far"))
        return _sift(items, state, lambda s, x: (x["priority"] != p) | clear(_limit(s, x), x), lambda s, x: F.when(x["priority"] <= decided, passed(s, x)).otherwise(s))

    def by_level(items: Column) -> Column:
        for p in sorted({r["priority"] for r in rules()}):
            items = F.reverse(level(F.reverse(items), p, 2**31 - 1, lambda x: x["start"], lambda start, x: start >= _end(x), p - 1))
            items = level(items, p, -1, _end, lambda end, x: end <= x["start"], p)
        return items

    several = lambda x: F.size(F.array_distinct(F.transform(x, lambda s: s["label"]))) > 1
    return F.filter(_let(outermost, lambda x: F.when(several(x), by_level(x)).otherwise(x)), lambda s: s["label"] != "")


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`row`, the row of docs, and `found`: n_words, base (places of the base phrases) and detections.

    base and detections: arrays of (start, len, priority, label, sure), in words from 0. Null or empty text: no words,
    nothing found. Each row is judged alone, so repeated rows agree; no document gives no rows.
    """
    by_keyword: dict[str, list] = {}
    for r in rules():
        by_keyword.setdefault(r["keyword"], []).append(r)
    table = F.from_json(F.lit(json.dumps([{"keyword": k, "rules": x} for k, x in by_keyword.items()])), _RULES)
    base_rules = [(f"(?<= )(?:{phrase})(?= )", label) for phrase, label in BASE]
    lines = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), words(docs[text_col].cast("string")).alias("line"))
    line = F.col("line")
    none = F.array().cast(_SPAN)
    base = F.concat(*[F.when(F.contains(line, F.lit(f" {phrase} ")), _spans(line, F.lit(p), F.lit(0), F.lit(label), F.lit(1.0))).otherwise(none) for (p, label), (phrase, _) in zip(base_rules, BASE, strict=True)])
    gate = F.lit(False)
    for k in gates():
        gate = gate | F.contains(line, F.lit(k))
    tried = F.filter(F.flatten(F.transform(F.filter(table, lambda g: F.contains(line, g["keyword"])), lambda g: g["rules"])), lambda r: F.regexp_like(line, r["pattern"]))
    detections = F.when(gate, _resolved(F.concat(_by_rules(line, tried), _in_expressions(line)))).otherwise(F.array().cast(_PLACED))
    found = F.transform(detections, lambda d: F.struct(d["start"].alias("start"), (-d["shorter"]).alias("len"), d["priority"].alias("priority"), d["label"].alias("label"), d["sure"].alias("sure")))
    n_words = F.when(F.trim(line) == "", F.lit(0)).otherwise(_blanks(line) - 1)
    return lines.select("row", F.struct(n_words.cast("long").alias("n_words"), base.alias("base"), found.alias("detections")).alias("found"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score, the surest detection."""
    base, more = F.col("found.base"), F.col("found.detections")
    start = F.transform(base, lambda s: s["start"])
    names = lambda x: F.transform(x, lambda s: s["label"])
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    sure = F.array_max(F.transform(F.concat(base, more), lambda s: s["sure"]))
    return found.select(
        F.col(f"row.{id_col}").alias("doc_id"),
        F.col("found.n_words").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(start).cast("long").alias("first_word"),
        F.array_max(start).cast("long").alias("last_word"),
        joined(names(base)).alias("base_labels"),
        joined(names(F.concat(base, more))).alias("labels"),
        F.coalesce(sure, F.lit(0.0)).alias("score"),
    )


#: The base columns, which SQL can express; labels and score come from the rules and are compared with a plain version in the tests.
BASE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
p AS (
  SELECT doc_id, len(w) AS n,
         [i FOR i IN range(1, len(w) + 1) IF array_to_string(w[i : i + 3], ' ') = 'under the mit license'] AS a,
         [i FOR i IN range(1, len(w) + 1) IF array_to_string(w[i : i + 3], ' ') = 'apache license version 2'] AS b,
         [i FOR i IN range(1, len(w) + 1) IF array_to_string(w[i : i + 2], ' ') = 'cc by nc'] AS c
  FROM d)
SELECT doc_id, n::BIGINT AS n_words, len(a) + len(b) + len(c) AS n_base, list_min(a || b || c) - 1 AS first_word, list_max(a || b || c) - 1 AS last_word,
       array_to_string(list_filter([CASE WHEN len(b) > 0 THEN 'apache-2' END, CASE WHEN len(c) > 0 THEN 'cc-by-nc' END, CASE WHEN len(a) > 0 THEN 'mit' END], lambda x: x IS NOT NULL), ',') AS base_labels
FROM p
"""
