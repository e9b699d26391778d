"""Personal data: candidate spans, scored by boosted trees.

Base patterns (``pii_patterns``) give spans that always stay. Beside them,
high-recall generators, several a kind, propose spans that may overlap: addresses
spelled with "at" and "dot" or with spaces, phone numbers in any grouping or none,
IPv6 addresses with and without "::" and anything that looks like them, IPv4
addresses with their dots spelled out, and runs of card length that fail the check
digit or use other separators. Features of a candidate's format and of the text
around it go into boosted trees, once a candidate. Those whose calibrated
probability reaches the threshold of their kind are accepted. Of accepted ones that
overlap the most probable is taken first (the longer of equals, then the earlier),
then the next that overlaps none taken, and so on, within islands of spans that hang
together. A candidate that overlaps a base span is scored only if it covers that
span and more; so base spans are made longer, never split or doubled.

The trees are fitted on ``labelled_examples``: at most ``EXAMPLES`` short texts
made from templates, whose labels are drawn with a probability that depends on
format and context, so that neither settles a label alone; the features are
computed by the same expressions. A third of the examples is held out to calibrate
the probabilities and to choose the thresholds. Everything on the way of the
documents is built-in functions: no shuffle, no Python on the executors.

Rows: a null text is the empty one and has no spans; texts of any length are read
whole; repeated rows get the same answer; an empty table gives an empty result;
further columns pass through, but those named pii_base or pii_all, which are
replaced.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coastline.llm.boosting import BoostedTrees
from coastline.llm.common import fresh
from coastline.llm.pii_patterns import BLOCK, KINDS, LINEAR, NEEDS, base_spans, digits, luhn, positions

EXAMPLES = 2_400
PRECISION = 0.9
#: Characters before and after a candidate that features look at.
CONTEXT = 40
#: Code points in each piece of a text from which contexts are taken.
PIECE = 1_024

_AT = r"(?:\x20?[(\[{<]\x20?(?:at?|@)\x20?[)\]}>]\x20?|\x20at\x20)"
_DOT = r"(?:\x20?[(\[{<]\x20?dot\x20?[)\]}>]\x20?|\x20dot\x20|\.)"
#: Each takes time linear in the text: runs are possessive, or of a bounded length.
GENERATORS = {
    "email": (
        rf"(?i)(?<![A-Za-z0-9._%+-])(?:[A-Za-z0-9_%+-]++\x20dot\x20){{0,3}}[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++",
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?@\x20?[A-Za-z0-9-]++(?:\x20?\.\x20?[A-Za-z0-9-]++)++",
    ),
    "ip": (
        r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?:%[0-9A-Za-z]{1,15}+)?(?![0-9A-Za-z:])",
        r"(?i)(?<![0-9])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\x20?[(\[]dot[)\]]\x20?|\x20dot\x20)[0-9]{1,3}){3}(?![0-9])",
    ),
    "card": (LINEAR["card"], r"(?<![0-9.])[0-9]{4}(?:[./_\x20-]{1,3}[0-9]{4}){2}[./_\x20-]{1,3}[0-9]{1,7}(?![0-9])"),
    "phone": (
        r"(?<![0-9A-Za-z+])(?<![0-9][\x20.-])\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z]|[\x20.-][0-9])",
        r"(?<![0-9A-Za-z+.,/-])[0-9]{7,11}(?![0-9A-Za-z]|[.,/-][0-9])",
        r"(?<![0-9A-Za-z+])(?<![0-9][\x20./-])(?:\(0\)[0-9]{2,4}|\(?[0-9]{1,5}\)?)(?:[\x20./-]{1,2}[0-9]{2,8}){1,4}(?![0-9A-Za-z]|[\x20./-][0-9])",
    ),
}
GENERATOR_NEEDS = {"email": r"(?i)[(\[{<\x20](?:at?|@)\x20?[)\]}>\x20]|[A-Za-z0-9]\x20?@", "ip": r"[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]{0,4}:|(?i)[0-9](?:.\.|\x20?.?dot)", "card": NEEDS["card"], "phone": r"(?:[0-9][\x20./()-]{0,2}){6}[0-9]"}

#: Words around a span that speak for a kind, and those that speak against any.
CUES = {
    "email": r"\b(?:e-?mail|mail|write|contact|reach|address|send|inbox)\b",
    "ip": r"\b(?:ip|ipv6|host|server|login|addr|ping|router|gateway|dns)\b",
    "card": r"\b(?:card|visa|mastercard|amex|credit|debit|payment)\b",
    "phone": r"\b(?:phone|call|calls|tel|telephone|telefon|telefono|téléphone|teléfono|handy|mobil|mobile|cell|fax|whatsapp|sms|number|ring|dial|text|office|hotline)\b",
    "none": r"\b(?:order|isbn|invoice|serial|version|page|pages|ref|part|item|sku|batch|ticket|no|nr|id|date|time|year|total|sum|price|code)\b",
}
#: Ends of domain names that are common.
ENDS = "com|org|net|edu|gov|info|biz|io|co|me|app|dev|ai|de|fr|es|it|nl|uk|eu|ch|at|se|no|pl|pt|ru|cn|jp|kr|in|br|ca|au|us|example|test"
ITEMS = "array<struct<start:bigint,end:bigint,p:int,proposed:boolean,kind:string,found:string>>"
CONTEXTS = "array<struct<start:bigint,end:bigint,kind:string,found:string,before:string,after:string>>"
SPANS = "array<struct<start:bigint,p:int,end:bigint,kind:string>>"


def candidates(text: str, kind: str) -> str:
    """What the kind's generators propose, in SQL; two may propose the same."""
    place = KINDS.index(kind) + 1
    row = f"named_struct('start', s.start, 'end', s.`end`, 'p', {place}, 'proposed', true, 'kind', '{kind}', 'found', s.found)"
    found = f"transform(concat({', '.join(positions(text, g) for g in GENERATORS[kind])}), s -> {row})"
    return f"IF({text} RLIKE r'{GENERATOR_NEEDS[kind]}', {found}, CAST(array() AS {ITEMS}))"


def islands(spans: str) -> str:
    """Spans sorted by start, in groups that hang together by overlaps, in SQL.

    A span opens an island where all before it have ended. The furthest end so far is
    carried over blocks, then within each block, so that no long array is copied a
    span at a time.
    """
    blocks = f"transform(sequence(0, CAST(floor((size(ss) - 1) / {BLOCK}) AS INT)), i -> array_max(transform(slice(ss, i * {BLOCK} + 1, {BLOCK}), x -> x.`end`)))"
    reached = f"aggregate({blocks}, named_struct('reach', -1L, 'out', CAST(array() AS array<bigint>)), (acc, r) -> named_struct('reach', greatest(acc.reach, r), 'out', concat(acc.out, array(acc.reach))), acc -> acc.out)"
    flags = "aggregate(slice(ss, k * {b} + 1, {b}), named_struct('reach', r, 'out', CAST(array() AS array<boolean>)), (acc, x) -> named_struct('reach', greatest(acc.reach, x.`end`), 'out', concat(acc.out, array(x.start >= acc.reach))), acc -> acc.out)".format(b=BLOCK)
    opens = f"filter(transform(flatten(transform({reached}, (r, k) -> {flags})), (f, i) -> IF(f, i + 1, 0)), i -> i > 0)"
    cut = f"flatten(transform(array({opens}), os -> transform(os, (o, k) -> slice(ss, o, coalesce(try_element_at(os, k + 2), size(ss) + 1) - o))))"
    # the outer array names what is used several times
    return f"flatten(transform(filter(array({spans}), ss -> size(ss) > 0), ss -> {cut}))"


def scorable(items: str) -> str:
    """Of base spans and candidates in order the candidates, once each, that no base span stands in the way of, in SQL."""
    again = "i > 0 AND island[i - 1].proposed AND island[i - 1].start = c.start AND island[i - 1].`end` = c.`end` AND island[i - 1].p = c.p"
    blocked = "exists(island, b -> NOT b.proposed AND b.start < c.`end` AND c.start < b.`end` AND NOT (c.start <= b.start AND b.`end` <= c.`end` AND c.`end` - c.start > b.`end` - b.start))"
    return f"flatten(transform({islands(items)}, island -> filter(island, (c, i) -> c.proposed AND NOT ({again}) AND NOT {blocked})))"


def with_context(text: str, spans: str) -> str:
    """Candidates with the text around them, in SQL: from pieces of the text, since a late place is found by counting from the start."""

    def cut(first: str, last: str) -> str:
        """Code points ``first`` to ``last`` (exclusive) of the text, at most ``CONTEXT``."""
        at = f"CAST(floor({first} / {PIECE}) AS INT)"
        both = f"concat(coalesce(try_element_at(pieces, {at} + 1), ''), coalesce(try_element_at(pieces, {at} + 2), ''))"
        return f"lower(substring({both}, CAST({first} - {at} * {PIECE} + 1 AS INT), CAST({last} - {first} AS INT)))"

    first = f"greatest(0L, s.start - {CONTEXT})"
    row = f"named_struct('start', s.start, 'end', s.`end`, 'kind', s.kind, 'found', s.found, 'before', {cut(first, 's.start')}, 'after', {cut('s.`end`', f'(s.`end` + {CONTEXT})')})"
    return f"flatten(transform(filter(array({spans}), c -> size(c) > 0), cs -> flatten(transform(array(regexp_extract_all({text}, r'(?s).{{1,{PIECE}}}', 0)), pieces -> transform(cs, s -> {row})))))"


def features() -> list[str]:
    """Numbers that describe a candidate ``c``'s format and context, in SQL."""
    number = digits("c.found")
    parts = "filter(split(c.found, '[^0-9]+'), x -> x != '')"

    def flag(x: str) -> str:
        return f"IF({x}, 1D, 0D)"

    def cue(place: str, pattern: str = "{}") -> str:
        return f"CASE c.kind {' '.join(f"WHEN '{k}' THEN {flag(f"c.{place} RLIKE r'{pattern.format(CUES[k])}'")}" for k in KINDS)} END"

    def shaped(pattern: str) -> str:
        return flag(f"c.found RLIKE r'{pattern}'")

    return [
        f"CASE c.kind {' '.join(f"WHEN '{k}' THEN {i}D" for i, k in enumerate(KINDS))} END",
        f"char_length({number})",
        "char_length(c.found)",
        "char_length(regexp_replace(c.found, '[0-9A-Za-z]', ''))",
        f"IF(char_length({number}) BETWEEN 12 AND 19, {flag(luhn(number))}, 0D)",
        shaped("^[(]"),
        f"size({parts})",
        f"coalesce(char_length(try_element_at({parts}, -1)), 0)",
        f"coalesce(char_length(try_element_at({parts}, 1)), 0)",
        shaped("^[(]?0"),
        shaped(rf"(?i)(?:[.]|dot[)\]}}>]?)\x20?(?:{ENDS})$"),
        shaped(r"(?i)[(\[{<]\x20?(?:at|dot)\x20?[)\]}>]|\[[.]\]|[(][.][)]"),
        shaped(r"(?i)\x20dot\x20|@"),
        shaped("::"),
        "char_length(regexp_replace(c.found, '[^:]', ''))",
        shaped("[A-Fa-f]|[0-9]{3}"),
        flag("size(filter(split(c.found, ':'), x -> char_length(x) = 2)) >= 3"),
        cue("before"),
        cue("before", r"{}(?:[^0-9a-z]*(?:is|me|at|to|or|on|from|us|under))?[^0-9a-z]*$"),
        cue("after"),
        flag(f"c.before RLIKE r'{CUES['none']}[^0-9a-z]*$'"),
        flag("c.before RLIKE r'[0-9A-Za-z#$€£]$'"),
        flag(r"c.after RLIKE r'^(?:[0-9a-z]|\x20?[%$€£°])'"),
        shaped(r"^[(]?[0-9]{3}[)]?[ .-]?[0-9]{3}[ .-][0-9]{4}$"),
        shaped(r"^[(]?[2-9][0-9]{2}[)]?[ .-]?[2-9][0-9]{2}[ .-][0-9]{4}$|^1[ .-][2-9][0-9]{2}[ .-][2-9][0-9]{2}[ .-][0-9]{4}$"),
        shaped(r"^[(]0[)]|^0"),
        shaped(r"^[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}$"),
        shaped(r"^0[0-9](?:[ .-][0-9]{2}){4}$"),
        shaped(r"^(?:19|20)[0-9]{2}[ ./-][01]?[0-9][ ./-][0-3]?[0-9]$|^[0-3]?[0-9][ ./-][0-3]?[0-9][ ./-](?:19|20)[0-9]{2}$"),
        f"size(array_distinct(split({number}, '')))",
    ]


def with_features(candidates_: str) -> str:
    """An array of candidates as (start, end, kind, x), x their features, in SQL."""
    x = ", ".join(f"CAST({f} AS DOUBLE)" for f in features())
    return f"transform({candidates_}, c -> named_struct('start', c.start, 'end', c.`end`, 'kind', c.kind, 'x', array({x})))"


def labelled_examples(n: int = EXAMPLES, seed: int = 11) -> list[tuple[str, str, int]]:
    """(text, kind, label): made from templates; each label is drawn by a probability of its format and context."""
    rng = random.Random(seed)
    pick = rng.choice
    word = lambda: "".join(pick("bcdfglmnprst") + pick("aeiou") for _ in range(rng.randint(1, 4)))
    plain = lambda: " ".join(word() for _ in range(rng.randint(1, 6)))
    number = lambda k: "".join(pick("0123456789") for _ in range(k))
    group = lambda k: "".join(pick("0123456789abcdef") for _ in range(k))
    cues = {
        "email": ["email", "e-mail", "mail me", "write to", "contact", "reach me", "send it to", "my address is"],
        "ip": ["ip", "ip address", "host", "server", "login from", "ping", "router", "the gateway is", "dns"],
        "card": ["card", "credit card", "visa", "payment card", "debit card", "my card is", "mastercard"],
        "phone": ["phone", "call", "tel", "mobile", "fax", "whatsapp", "my number is", "ring", "dial", "text me at", "cell", "telefon", "telephone", "handy", "office", "hotline"],
    }
    none = ["order", "isbn", "invoice", "serial", "version", "page", "ref", "part", "item", "sku", "batch", "ticket", "id", "date", "total"]

    def filled(shape: str) -> str:
        return "".join(pick("0123456789") if c == "#" else pick("23456789") if c == "N" else pick("01") if c == "O" else c for c in shape)

    def email() -> tuple[str, float]:
        name, end = word() + pick(["", ".", "_", number(2)]) + pick(["", word()]), pick(ENDS.split("|"))
        r = rng.random()
        if r < 0.25:
            at, dot = pick([("(at)", "(dot)"), ("[at]", "[dot]"), (" [at] ", "."), (" [@] ", "."), ("(a)", "."), ("(@)", "."), (" (AT) ", " (DOT) "), ("{at}", "{dot}")])
            return f"{name}{at}{word()}{dot}{end}", 0.98
        if r < 0.5:
            at, dot = pick([(" at ", " dot "), (" AT ", " DOT ")])
            return f"{pick(['', '', word() + ' dot '])}{name}{at}{word()}{dot}{end}", 0.96
        if r < 0.6:
            return f"{name}{pick([' @ ', ' @', '@ '])}{word()}{pick(['.', ' . '])}{end}", 0.95
        if r < 0.72:
            return f"{name} at {word()}.{end}", 0.85
        return f"{word()} at {word()}{pick(['.', ' dot '])}{word()}", 0.02

    def ip() -> tuple[str, float]:
        r = rng.random()
        if r < 0.2:
            return ":".join(group(rng.randint(1, 4)) for _ in range(8)), 0.98
        if r < 0.5:
            a, b = rng.randint(1, 4), rng.randint(0, 3)
            return ":".join(group(rng.randint(1, 4)) for _ in range(a)) + "::" + ":".join(group(rng.randint(1, 4)) for _ in range(b)) + (pick(["", "", "%eth0", "%en1"]) if b else ""), 0.95 if a + b > 2 else 0.8
        if r < 0.6:
            return pick(["[.]", " dot ", "(.)", "[dot]"]).join(str(rng.randint(0, 255)) for _ in range(4)), 0.95
        if r < 0.75:
            return ":".join(group(2) for _ in range(6)), 0.03
        if r < 0.8:
            return "::", 0.0
        return filled(pick(["##:##:##", "#:##:##", "##:##:##", "###:##:#"])), 0.02

    def card() -> tuple[str, float]:
        d = number(16)
        text = pick([d, "-".join(d[i : i + 4] for i in range(0, 16, 4)), " ".join(d[i : i + 4] for i in range(0, 16, 4)), ".".join(d[i : i + 4] for i in range(0, 16, 4)), number(rng.randint(12, 19)), filled("###-#-##-######-#"), filled("#### ###### #####")])
        return text, 0.05

    def phone() -> tuple[str, float]:
        r = rng.random()
        if r < 0.3:
            return filled(pick(["(N##) N##-####", "N##-N##-####", "N##.N##.####", "N## N## ####", "(N##) N## ####", "1-N##-N##-####", "1 N## N## ####"])), 0.8
        if r < 0.4:
            return filled(pick(["0# ## ## ## ##", "0#.##.##.##.##", "0#-##-##-##-##"])), 0.8
        if r < 0.55:
            return filled(pick(["0## #### ####", "0#### ######", "0##/#######", "0### ### ####", "00## ## ########", "0## ### ####", "(0)## #### ####", "(0)### ######", "0## ######"])), 0.6
        if r < 0.75:
            return number(rng.randint(7, 11)), 0.04
        if r < 0.87:
            return filled(pick(["19##-0#-1#", "20##.0#.2#", "1#/0#/20##", "0#-1#-19##", "20## 1# 0#"])), 0.0
        return filled(pick(["### ### ####", "#### ####", "### ### ###", "## ### ## ###", "#### #### ###", "### ####", "O##-###-####", "N##-O##-####", "O## ### ####"])), 0.06

    make = {"email": email, "ip": ip, "card": card, "phone": phone}
    rows = []
    for i in range(n):
        kind = KINDS[i % 4]
        text, p = make[kind]()
        before, after, r = plain(), plain(), rng.random()
        if r < 0.35:
            before = f"{plain()} {pick(cues[kind])}{pick(['', ':', ' ', ' =', ','])}".rstrip()
            p = max(p, 0.99) if p >= 0.04 else p
        elif r < 0.42:
            before = f"{pick(cues[kind])} {word()} {word()}"
            p = min(0.97, p + 0.5) if p >= 0.04 else p
        elif r < 0.5:
            after = f"is my {pick(cues[kind])} {plain()}"
            p = min(0.99, p + 0.9) if p >= 0.04 else p
        elif r < 0.68:
            before = f"{plain()} {pick(none)}{pick(['', ':', ' no', ' #'])}"
            p = p * (0.9 if kind in ("email", "ip") else 0.06)
        if rng.random() < 0.08 and kind in ("card", "phone"):
            after = pick(["%", " €", "kg", " $"]) + after
            p *= 0.1
        rows.append((f"{before} {text}{pick(['', '.', ','])} {after}" if not after.startswith(("%", "kg", " €", " $")) else f"{before} {text}{after}", kind, int(rng.random() < p)))
    return rows


class Detector:
    """Fitted trees and the threshold of each kind."""

    def __init__(self, spark: SparkSession, examples: int = EXAMPLES, precision: float = PRECISION):
        made = spark.createDataFrame([(i, *r) for i, r in enumerate(labelled_examples(examples))], "i int, text string, kind string, label int")
        pool = with_context("text", f"filter(concat({', '.join(candidates('text', k) for k in KINDS)}), c -> c.kind = kind)")
        # of the spans proposed for an example the longest is the one that was put there
        longest = f"slice(array_sort({pool}, (a, b) -> CAST(b.`end` - b.start - a.`end` + a.start AS INT)), 1, 1)"
        rows = made.select("i", "label", "kind", F.expr(longest).alias("c")).where("size(c) > 0")
        rows = rows.select("i", "label", "kind", F.expr(f"{with_features('c')}[0].x").alias("x")).orderBy("i").collect()
        x, y = np.array([r.x for r in rows]), np.array([r.label for r in rows], float)
        kinds = np.array([r.kind for r in rows])
        self.trees = BoostedTrees(x, y, rounds=40, depth=3, rate=0.3)
        self.thresholds = {k: max(0.5, self.trees.threshold(x, y, precision, kinds == k)) for k in KINDS}

    def scored(self, column: str) -> Column:
        """An array of candidates (start, end, kind, x) with their places in the order of kinds and their probabilities, where sure enough."""
        places, limits = (" ".join(f"WHEN '{k}' THEN {v}" for k, v in of.items()) for of in ({k: i + 1 for i, k in enumerate(KINDS)}, {k: f"{v!r}D" for k, v in self.thresholds.items()}))
        score = self.trees.sql(lambda i: f"c.x[{i}]")
        each = f"named_struct('start', c.start, 'p', CASE c.kind {places} END, 'end', c.end, 'kind', c.kind, 'score', {score})"
        return F.expr(f"array_sort(filter(transform(`{column}`, c -> {each}), c -> c.score >= CASE c.kind {limits} END))")


def best(column: str) -> Column:
    """Of sure candidates in order: the first by rank of each island, then each that overlaps none taken; rank: probability, length, place."""
    rank = lambda c: f"struct({c}.score, {c}.`end` - {c}.start, -{c}.start, -{c}.p)"
    ranked = f"array_sort(island, (a, b) -> CASE WHEN {rank('a')} > {rank('b')} THEN -1 WHEN {rank('a')} < {rank('b')} THEN 1 ELSE 0 END)"
    span = "named_struct('start', c.start, 'p', c.p, 'end', c.`end`, 'kind', c.kind)"
    taken = f"aggregate({ranked}, CAST(array() AS {SPANS}), (acc, c) -> IF(exists(acc, d -> d.start < c.`end` AND c.start < d.`end`), acc, concat(acc, array({span}))))"
    return F.expr(f"flatten(transform({islands(f'`{column}`')}, island -> {taken}))")


def _place(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)


def in_order(spans: Column) -> Column:
    """Spans by start, then kind as listed, then end."""
    rows = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), _place(s["kind"]).alias("p"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_sort(rows)


def of_kind(spans: Column | str, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, detector: Detector | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with pii_base and pii_all: arrays of (start, p, end, kind) in order, p the kind's place."""
    detector = detector or Detector(docs.sparkSession)
    docs_columns = docs.columns
    text, base, items, apart, sure, row = fresh(6)
    kinds = {k: fresh(2) for k in KINDS}
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs_columns]).alias(row), F.coalesce(F.col(text_col), F.lit("")).alias(text))
    found = docs.select(row, text, *[F.expr(base_spans(text, k)).alias(kinds[k][0]) for k in KINDS], *[F.expr(candidates(text, k)).alias(kinds[k][1]) for k in KINDS])
    found = found.select(row, text, in_order(F.concat(*[F.col(kinds[k][0]) for k in KINDS])).alias(base), F.concat(*[F.col(kinds[k][1]) for k in KINDS]).alias(items))
    fixed = f"transform({base}, b -> named_struct('start', b.start, 'end', b.`end`, 'p', b.p, 'proposed', false, 'kind', b.kind, 'found', ''))"
    found = found.select(row, text, base, F.expr(f"IF(size({items}) > 0, {scorable(f'array_sort(concat({fixed}, {items}))')}, CAST(array() AS {ITEMS}))").alias(apart))
    found = found.select(row, base, F.expr(f"IF(size({apart}) > 0, {with_context(text, apart)}, CAST(array() AS {CONTEXTS}))").alias(apart))
    found = found.select(row, base, F.expr(f"IF(size({apart}) > 0, {with_features(apart)}, NULL)").alias(apart))
    found = found.select(row, base, F.when(F.col(apart).isNotNull(), detector.scored(apart)).alias(sure))
    added = F.when(F.size(sure) > 0, F.array_sort(F.concat(base, best(sure).cast(SPANS)))).otherwise(F.col(base))
    kept = [F.col(row).getField(c).alias(c) for c in docs_columns if c not in ("pii_base", "pii_all")]
    return found.select(*kept, F.col(base).alias("pii_base"), added.alias("pii_all"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span, overlapping ones together, replaced by its kind in brackets."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(F.lit(0), s["start"] - acc["at"]).cast("int"))
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    def finish(acc: Column) -> Column:
        return F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.char_length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, finish)).otherwise(text)
