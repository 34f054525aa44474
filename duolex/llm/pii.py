"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their scores.

Only SQL functions. Matches are found by marking them with two control
characters, splitting at the first one and adding up the pieces' lengths, so
that the work grows with the text's length alone, whatever the number of
matches. The repeats are possessive and the first position is tied to a run's
start, which leaves each pattern's matches as they are and keeps the regular
expression engine from going back over long runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban")
#: The kinds of the fixed patterns; the others are this method's own.
BASE = KINDS[:4]

PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
#: A text without this holds no match.
NEEDS = {"email": "@", "phone": "+"}
#: Score of a confirmed span, and what a whole word of the kind's list (or its plural) within NEAR characters adds. The
#: characters before it reach back to the start of the kind's match before it, those after it to the next match.
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.5, "iban": 0.8}
BONUS, NEAR = 0.2, 40
WORDS = {
    "email": "e?mail|contact|write|reply|address",
    "ip": "server|host|address|login|network|ip",
    "card": "card|visa|credit|debit|payment|account",
    "phone": "phone|call|mobile|tel|fax|contact",
    "iban": "iban|bank|account|transfer|konto",
}

_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
_MOD97 = """
    aggregate(filter(split(concat(substring(s, 5), left(s, 4)), ''), c -> c <> ''), 0,
              (a, c) -> if(ascii(c) < 58, (a * 10 + ascii(c) - 48) % 97, (a * 100 + ascii(c) - 55) % 97)) = 1"""
VALID = {
    "email": "true",
    "ip": rf"x.found rlike '^{_BYTE}(?:\\.{_BYTE}){{3}}$'",
    "card": "exists(array(regexp_replace(x.found, '[ -]', '')), d -> length(d) between 12 and 19 and luhn_check(d))",
    "phone": "length(regexp_replace(x.found, '[^0-9]', '')) between 9 and 15",
    "iban": f"exists(array(replace(x.found, ' ', '')), s -> length(s) between 15 and 34 and {_MOD97})",
}


def _spans(kind: str, marked: str) -> str:
    """SQL for the confirmed spans of a kind, given the column with marked matches (null: none)."""
    starts = """
        aggregate(sequence(0, 30), transform(f, (x, i) -> char_length(x) - if(i > 0, 1, 0)),
                  (a, k) -> if(size(a) > shiftleft(1, k), transform(a, (x, i) -> if(i >= shiftleft(1, k), x + a[i - shiftleft(1, k)], x)), a))"""
    piece = f"""
        named_struct('start', p[i - 1], 'place', {KINDS.index(kind)}, 'found', substring_index(f[i], char(2), 1),
                     'near', lower(concat(right(f[i - 1], {NEAR}), ' ', left(substring_index(f[i], char(2), -1), {NEAR}))))"""
    found = f"transform(array(split({marked}, char(1))), f -> transform(array({starts}), p -> transform(sequence(1, size(f) - 1), i -> {piece}))[0])[0]"
    return f"""
        if({marked} is null, array(),
           transform(filter({found}, x -> {VALID[kind]}),
                     x -> named_struct('start', x.start, 'place', x.place, 'stop', x.start + char_length(x.found), 'kind', '{kind}',
                                       'score', {SCORES[kind]}D + if(x.near rlike '(?<![a-z])(?:{WORDS[kind]})s?(?![a-z])', {BONUS}D, 0D))))"""


def find_personal_data(df: DataFrame, text_col: str = "text", out: str = "spans") -> DataFrame:
    """Adds the column out: array<struct<start, place, stop, kind, score>>, by start and then kind as KINDS lists them.

    Starts and ends are code points, ends exclusive. Spans of the same kind
    don't overlap, spans of two kinds may. A row for each input row with all
    its columns (a column named out is replaced); a null or empty text has no
    spans. No shuffle and no memory beyond the row.
    """
    marks = {k: f"__pii_{k}" for k in KINDS}
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = [F.col(f"`{c}`") for c in df.columns if c.lower() != out.lower()]
    plain = F.when(F.contains(text, F.lit("\x01")) | F.contains(text, F.lit("\x02")), F.translate(text, "\x01\x02", "\x03\x03")).otherwise(text)
    df = df.select(*own, plain.alias("__pii_text"))

    def mark(kind: str):
        made = F.nullif(F.regexp_replace("__pii_text", F.lit(PATTERNS[kind]), F.lit("\x01$0\x02")), F.col("__pii_text"))
        return F.when(F.contains("__pii_text", F.lit(NEEDS[kind])), made) if kind in NEEDS else made

    marked = df.select(*own, *(mark(k).alias(m) for k, m in marks.items()))
    every = ", ".join(_spans(k, m) for k, m in marks.items())
    return marked.select(*own, F.expr(f"array_sort(concat({every}))").alias(out))


def redact(df: DataFrame, text_col: str = "text", spans: str = "spans") -> DataFrame:
    """The text with every stretch that spans cover replaced by its first span's kind in brackets; texts without spans stay as they are."""
    pieces = f"""
        aggregate({spans}, named_struct('at', 0, 'parts', cast(array() as array<string>)),
            (a, x) -> if(x.stop <= a.at, a,
                named_struct('at', x.stop, 'parts', if(x.start < a.at, a.parts,
                    concat(a.parts, array(substring({text_col}, a.at + 1, x.start - a.at), concat('[', upper(x.kind), ']')))))),
            a -> concat(array_join(a.parts, ''), substring({text_col}, a.at + 1)))"""
    return df.withColumn(text_col, F.expr(f"if(size({spans}) = 0, {text_col}, {pieces})"))
