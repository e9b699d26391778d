"""Personal data: the base patterns, and where in a text they match, in SQL functions.

Spark returns what a pattern matches but not where. Splitting a text by the
same pattern gives what stands between the matches, and the lengths of both
give every position.

The patterns match what the plain ones do, in time linear in the text and
without recursion: a match can only start where a run of its characters starts
(or where the last match ended), so other starts are ruled out by a
look-behind, and runs are possessive where what follows can't be part of them.
Card runs of fewer than 12 digits, which would be dropped, aren't matched.
"""

from __future__ import annotations

KINDS = ("email", "ip", "card", "phone")

#: The base patterns of the four kinds.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LINEAR = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a kind to be looked for at all.
NEEDS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": "\\+[0-9]"}

PLACES = "array<struct<start:bigint,end:bigint,found:string>>"
SPAN = "array<struct<start:bigint,end:bigint,kind:string,found:string>>"
#: Matches that are added up together; a text may have any number of them.
BLOCK = 128


def positions(text: str, pattern: str) -> str:
    """Where a pattern matches, in SQL: an array of (start, end, found), in code points, end exclusive.

    The lengths are added up within blocks and then over the blocks, since
    appending to an array copies it.
    """
    pairs = f"filter(arrays_zip(split({text}, r'{pattern}', -1), regexp_extract_all({text}, r'{pattern}', 0)), x -> x.`1` IS NOT NULL)"
    length = "CAST(char_length(x.`0`) + char_length(x.`1`) AS BIGINT)"
    blocks = f"transform(sequence(0, CAST(floor((size(ps) - 1) / {BLOCK}) AS INT)), i -> slice(ps, i * {BLOCK} + 1, {BLOCK}))"
    empty = "CAST(array() AS array<struct<at:bigint,pairs:array<struct<`0`:string,`1`:string>>>>)"
    placed = (
        f"aggregate({blocks}, named_struct('at', 0L, 'out', {empty}), (acc, b) -> named_struct('at', acc.at + aggregate(b, 0L, (a, x) -> a + {length}),"
        " 'out', concat(acc.out, array(named_struct('at', acc.at, 'pairs', b)))), acc -> acc.out)"
    )
    row = f"named_struct('start', acc.at + char_length(x.`0`), 'end', acc.at + {length}, 'found', x.`1`)"
    located = f"aggregate(block.pairs, named_struct('at', block.at, 'out', CAST(array() AS {PLACES})), (acc, x) -> named_struct('at', acc.at + {length}, 'out', concat(acc.out, array({row}))), acc -> acc.out)"
    # the outer array names what is used several times
    return f"flatten(transform(array({pairs}), ps -> IF(size(ps) > 0, flatten(transform({placed}, block -> {located})), CAST(array() AS {PLACES}))))"


def digits(found: str) -> str:
    return f"regexp_replace({found}, '[^0-9]', '')"


def luhn(number: str) -> str:
    """Whether a string of digits passes the Luhn test."""
    worth = "IF(i % 2 = 0, CAST(d AS INT), 2 * CAST(d AS INT) - IF(CAST(d AS INT) > 4, 9, 0))"
    return f"(aggregate(transform(split(reverse({number}), ''), (d, i) -> {worth}), 0, (a, x) -> a + x) % 10 = 0)"


def valid(kind: str, found: str) -> str:
    """The test that a match of a base pattern has to pass."""
    if kind == "ip":
        return f"forall(split({found}, r'[.]'), part -> part RLIKE r'^0*(?:[0-9]{{1,2}}|1[0-9]{{2}}|2[0-4][0-9]|25[0-5])$')"
    if kind == "card":
        return f"IF(char_length({digits(found)}) BETWEEN 12 AND 19, {luhn(digits(found))}, false)"
    if kind == "phone":
        return f"char_length({digits(found)}) BETWEEN 9 AND 15"
    return "true"


def base_spans(text: str, kind: str) -> str:
    """The base spans of one kind, in SQL."""
    rows = f"transform(filter({positions(text, LINEAR[kind])}, s -> {valid(kind, 's.found')}), s -> named_struct('start', s.start, 'end', s.`end`, 'kind', '{kind}', 'found', s.found))"
    return f"IF({text} RLIKE r'{NEEDS[kind]}', {rows}, CAST(array() AS {SPAN}))"
