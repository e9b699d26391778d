"""License scans by sentence rules.

A text is cut into sentences, each is normalised and looked up among the known
sentences of licences; the identifiers found, in order, are then matched
against ordered rules: a rule is a sequence of identifiers, at most
``gap`` other known sentences apart, and what one rule has matched is not seen
by later ones. Longer rules stand before the single sentences they contain.

Before the cut, the real sentences of the notices of MIT, BSD, ISC, Apache,
Mozilla, Eclipse, Boost, zlib, Unlicense, WTFPL, Creative Commons and GNU
(``notices``) are found wherever their lines are wrapped, also inside comments,
and each is put on a line of its own in the known form; a line break between two
words that follow each other in a known one-line sentence is joined. An SPDX
line gives an identifier for each licence of its expression.

All of it is built-in functions on the rows where they lie. A text without any
of a few cue words, one of which every known sentence has, isn't cut at all.

Rows: a null text has no licences; texts of any length are read whole; where two
rules could match, the one listed first does; repeated rows get the same answer;
an empty table gives an empty result; further columns pass through, but those
named like a new column, which it replaces.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coastline.llm.common import ascii_lower, fresh

GAP = 2
#: Every known sentence has one of these.
CUES = ("licen", "permission", "provided", "redistribut", "gnu general", "copyright", "warrant", "unencumbered", "wtf public", "misrepresented", "endorse", "creative commons attribution", "cc0")
#: A sentence ends at a line's end, or at a mark that white space follows.
SENTENCE_END = r"[\n\r]+|(?<=[.!?;])\s+"

CC_PARTS = ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
GNU = {"gpl": "general public", "lgpl": "lesser general public", "agpl": "affero general public"}
GNU_VERSIONS = ("2", "2.1", "3")

#: Other licences that notices name.
NAMED = {
    "mozilla public license version 2 0": "mpl-2.0", "mozilla public license version 1 1": "mpl-1.1", "eclipse public license version 2 0": "epl-2.0", "eclipse public license version 1 0": "epl-1.0",
    "boost software license version 1 0": "bsl-1.0", "cc0 1 0 universal license": "cc0-1.0",
}
#: Identifiers of the SPDX list.
SPDX = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0", "GPL-2.0+", "GPL-2.0-only",
    "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "WTFPL", "Zlib",
)


def _plain(name: str) -> str:
    return " ".join("".join(c if c.isalnum() else " " for c in name.lower()).split())


#: Sentences of permissive licences, normalised.
PERMISSIVE = {
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "zlib-origin": "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "wtfpl": "do what the fuck you want to public license",
    "apache-copy": "you may not use this file except in compliance with the license",
    "apache-obtain": "you may obtain a copy of the license at",
}


def sentences() -> dict[str, str]:
    """Normalised sentence -> identifier."""
    out = {s: i for i, s in PERMISSIVE.items()}
    for verb in ("released", "licensed", "distributed", "available"):
        out |= {f"{verb} under the {name} license": f"{key}-line" for key, name in (("mit", "mit"), ("bsd", "bsd"), ("isc", "isc"))}
        out |= {f"{verb} under the apache license version {v.replace('.', ' ')}": f"apache-{v}-line" for v in ("1.1", "2.0")}
    for part in CC_PARTS:
        for v in CC_VERSIONS:
            for head in ("licensed", "this work is licensed"):
                out[f"{head} under cc {part.replace('-', ' ')} {v.replace('.', ' ')}"] = f"cc-{part}-{v}-line"
        out[f"licensed under cc {part.replace('-', ' ')}"] = f"cc-{part}-line"
    for name, key in NAMED.items():
        for head in ("released", "licensed", "distributed", "available"):
            out[f"{head} under the {name}"] = f"{key}-line"
    out |= {f"spdx license identifier {_plain(x)}": f"spdx-{x}-line" for x in SPDX}
    for key, name in GNU.items():
        for v in GNU_VERSIONS:
            for head in ("this work is licensed", "this program is licensed", "this software is licensed", "licensed", "released", "distributed"):
                out[f"{head} under the gnu {name} license version {v.replace('.', ' ')}"] = f"{key}-{v}-line"
    return out


#: Between two words of a notice: marks, white space, line breaks and comment marks.
GAPS = "[^0-9A-Za-z]++"
#: A single line break, and the comment mark the next line may begin with.
BREAK = r"[ \t]*+\r?\n[ \t]*+(?:(?://++|#++|[*]++|;++|--++|%++)[ \t]*+)?"

#: How the real notices' sentences go on after the known ones.
TAILS = {
    "mit-grant": "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "as-is": "including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "zlib-origin": "if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required",
}


def notices() -> list[tuple[str, str]]:
    """(pattern of a real sentence however it is wrapped, what stands for it)."""
    wrapped = lambda words: words.replace(" ", GAPS)
    out = []
    for key, sentence in PERMISSIVE.items():
        body = wrapped(sentence)
        for optional in ("distribute", "other"):
            body = body.replace(f"and{GAPS}or{GAPS}{optional}", f"and{GAPS}(?:or{GAPS})?{optional}")
        if key == "bsd-endorse":
            body = body.replace(wrapped("the copyright holder"), f"(?:[0-9A-Za-z]++{GAPS}){{1,8}}?(?=nor{GAPS}the)").replace(f"){GAPS}nor", ")nor")
        more = f"(?:{GAPS}{wrapped(TAILS[key])}\\b)?" if key in TAILS else ""
        out.append((rf"(?i)\b{body}\b{more}[.;:,]?", f"\n{sentence}\n"))
    out.append((r"(?i)(SPDX-License-Identifier:[ \t]*+[(]?[0-9A-Za-z.+-]++)[ \t]++(?:OR|AND|WITH)[ \t]++(?:[0-9A-Za-z.+-]++[ \t]++(?:OR|AND)[ \t]++)?(?=[0-9A-Za-z.+-])", "$1\nSPDX-License-Identifier: "))
    named = rf"(?i)\b(?:{wrapped('this source code form is subject to')}|{wrapped('are made available under')}|subject{GAPS}to|under){GAPS}(?:the{GAPS}terms{GAPS}of{GAPS})?the{GAPS}(mozilla{GAPS}public|eclipse{GAPS}public|boost{GAPS}software){GAPS}license(?:{GAPS}(?:version|v))?{GAPS}([12])[.]([01])\b[.,;]?"
    out.append((named, "\nlicensed under the $1 license version $2 $3\n"))
    out.append((rf"(?i)\b{wrapped('creative commons')}{GAPS}(?:cc0|zero){GAPS}1[.]0(?:{GAPS}universal)?\b[.]?", "\nlicensed under the cc0 1 0 universal license\n"))
    parts = {"by-nc-sa": "noncommercial sharealike", "by-nc-nd": "noncommercial noderivatives", "by-nc": "noncommercial", "by-sa": "sharealike", "by-nd": "noderivatives", "by": ""}
    for part, words in parts.items():
        body = wrapped(f"creative commons attribution {words}".strip()).replace("noderivatives", "noderiv(?:ative)?s").replace("noncommercial", f"non{GAPS[:-2]}*+commercial").replace("sharealike", f"share{GAPS[:-2]}*+alike")
        out.append((rf"(?i)\b{body}{GAPS}([1-4])[.]([05])(?:{GAPS}international)?(?:{GAPS}(?:public{GAPS})?licen[sc]e)?\b[.]?", f"\nlicensed under cc {part.replace('-', ' ')} $1 $2\n"))
    disclaims = wrapped("the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness")
    out.append((rf"(?i)\b{disclaims}\b[.]?", f"\n{PERMISSIVE['as-is']}\n"))
    out.append((rf"(?i)\b{wrapped('licensed under the apache license version 2 0 the license')}\b[;,]?", "\nlicensed under the apache license version 2 0\n"))
    free = wrapped("is free software you can redistribute it and or modify it under the terms of the gnu")
    option = wrapped("or at your option any later version")
    for kind in GNU.values():
        gnu = rf"(?i)\b(?:this{GAPS})?[0-9a-z_-]+{GAPS}{free}{GAPS}{wrapped(kind)}{GAPS}license{GAPS}{wrapped('as published by the free software foundation')}{GAPS}(?:either{GAPS})?version{GAPS}(2[.]1|[23])(?![.]?[0-9])(?:{GAPS}{wrapped('of the license')}\b)?(?:{GAPS}{option}\b)?[.]?"
        out.append((gnu, f"\nlicensed under the gnu {kind} license version $1\n"))
    return out


def joined(text: Column) -> Column:
    """The text with its notices in their known form and known one-line sentences unwrapped."""
    follows: dict[str, set[str]] = {}
    for sentence, identifier in sentences().items():
        if identifier.endswith("-line"):
            words = sentence.split(" ")
            for a, b in zip(words, words[1:]):
                if a.isalpha():
                    follows.setdefault(a, set()).add(b)
    ahead = "|".join(f"{a},?{BREAK}(?:{'|'.join(sorted(b))})" for a, b in sorted(follows.items()))
    out = F.regexp_replace(text, rf"(?i)\b(?=(?:{ahead})\b)([a-z]+,?){BREAK}", "$1 ")
    return reduce(lambda t, n: F.regexp_replace(t, *n), notices(), out)


def rules() -> list[tuple[str, tuple[str, ...]]]:
    """(licence, identifiers in order), the first that matches wins."""
    out = [
        ("MIT", ("mit-grant", "mit-notice", "as-is")),
        ("MIT", ("mit-grant", "mit-notice")),
        ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
        ("BSD", ("bsd-grant", "bsd-source", "bsd-binary")),
        ("BSD", ("bsd-grant", "bsd-source")),
        ("ISC", ("isc-grant", "as-is")),
        ("Apache-2.0", ("apache-2.0-line", "apache-copy", "apache-obtain")),
        ("Apache-2.0", ("apache-2.0-line", "apache-copy")),
        ("Apache-2.0", ("apache-copy", "apache-obtain")),
    ]
    names = {"mit": "MIT", "bsd": "BSD", "isc": "ISC", "apache-1.1": "Apache-1.1", "apache-2.0": "Apache-2.0"}
    for identifier in sorted(set(sentences().values())):
        if identifier.endswith("-line"):
            key = identifier.removesuffix("-line")
            out.append((key.removeprefix("spdx-") if key.startswith("spdx-") else names.get(key, key.upper()), (identifier,)))
    out += [("MIT", ("mit-grant",)), ("BSD", ("bsd-grant",)), ("ISC", ("isc-grant",)), ("Zlib", ("zlib-as-is", "zlib-grant", "zlib-origin")), ("Zlib", ("zlib-grant",)), ("BSL-1.0", ("boost-grant",))]
    out += [("Unlicense", ("unlicense",)), ("WTFPL", ("wtfpl",))]
    return out


def rule_pattern(ids: tuple[str, ...], gap: int = GAP) -> str:
    """A pattern over identifiers that each stand between semicolons."""
    return f"(?:;[^;]*;){{0,{gap}}}".join(f";{i.replace('.', '[.]').replace('+', '[+]')};" for i in ids)


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(ascii_lower(sentence), "[^0-9a-z]+", " "))


def scan(docs: DataFrame, text_col: str = "text", gap: int = GAP) -> DataFrame:
    """``docs`` with license_ids (known sentences, in order) and licenses (sorted, distinct)."""
    known = sentences()
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    cued = reduce(lambda a, b: a | b, [low.contains(c) for c in CUES])
    cut = F.split(joined(F.col(text_col)), SENTENCE_END)
    looked, marks = fresh(2)
    with_cue = F.filter(cut, lambda s: reduce(lambda a, b: a | b, [F.lower(s).contains(c) for c in CUES]))
    docs = docs.withColumn(looked, F.when(cued, F.transform(with_cue, normalised)))
    docs = docs.withColumn("license_ids", F.coalesce(F.filter(F.transform(looked, lambda s: F.try_element_at(table, s)), lambda i: i.isNotNull()), F.array().cast("array<string>")))
    docs = docs.withColumn(marks, F.when(F.size("license_ids") > 0, F.array_join(F.transform("license_ids", lambda i: F.concat(F.lit(";"), i, F.lit(";"))), "")))
    found = F.struct(F.col(marks).alias("left"), F.array().cast("array<string>").alias("names"))
    book = F.array(*[F.struct(F.lit(rule_pattern(ids, gap)).alias("p"), F.lit(name).alias("name")) for name, ids in rules()])

    def use(acc: Column, rule: Column) -> Column:
        hit = F.rlike(acc["left"], rule["p"])
        return F.when(hit, F.struct(F.regexp_replace(acc["left"], rule["p"], F.lit(";;")).alias("left"), F.array_append(acc["names"], rule["name"]).alias("names"))).otherwise(acc)

    names = F.when(F.col(marks).isNotNull(), F.aggregate(book, found, use, lambda acc: F.array_sort(F.array_distinct(acc["names"]))))
    return docs.withColumn("licenses", F.coalesce(names, F.array().cast("array<string>"))).drop(looked, marks)


def oracle_sql() -> str:
    """The registered query in SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(s)}, {quoted(i)})" for s, i in sentences().items())
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    steps, names = "s0 AS (SELECT doc_id, ids AS left0, n FROM found)", []
    for k, (name, ids) in enumerate(rules()):
        p = quoted(rule_pattern(ids))
        steps += f", s{k + 1} AS (SELECT *, regexp_replace(left{k}, {p}, ';;', 'g') AS left{k + 1}, regexp_matches(left{k}, {p}) AS m{k} FROM s{k})"
        names.append(f"CASE WHEN m{k} THEN {quoted(name)} END")
    last = len(rules())
    return f"""
WITH known(sentence, id) AS (VALUES {values}),
cut AS (
  SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos
  FROM (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '[\\n\\r]+', chr(1), 'g'), '([.!?;])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM documents)
),
found AS (
  SELECT doc_id, string_agg(';' || id || ';', '' ORDER BY pos) AS ids, count(*) AS n
  FROM cut JOIN known ON sentence = trim(regexp_replace(translate(part, '{upper}', '{upper.lower()}'), '[^0-9a-z]+', ' ', 'g'))
  GROUP BY doc_id
),
{steps}
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_sentences,
       coalesce(array_to_string(list_sort(list_distinct(list_filter([{", ".join(names)}], lambda x: x IS NOT NULL))), ','), '') AS licenses
FROM documents d LEFT JOIN s{last} USING (doc_id)
"""
