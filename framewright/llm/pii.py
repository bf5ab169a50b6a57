r"""Personal data in whole texts: patterns propose spans, checksums confirm them, words nearby adjust the score.

Only built-in string and array expressions. A pattern's matches are put between two marker
characters, the text is cut at the markers, and a fold over the pieces adds up their lengths:
that gives positions in code points. Folds go over blocks of FOLD pieces, so the array that a step extends stays
short and the work is linear in the matches for any number that a text holds. Markers that a text itself holds are first exchanged
for another control character, which no pattern's class tells apart from them. Loops in the
patterns are possessive where the following character cannot continue them, and starts inside
a run that has failed once are skipped, so matching is linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import named, unused

OPEN, CLOSE, OTHER = "\x01", "\x02", "\x03"

#: kind -> pattern, in the order in which kinds are listed; fixed values. The first four are the base kinds.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "tel": r"(?<![0-9A-Za-z+])\([0-9]{3}\)\x20?[0-9]{3}[-.\x20][0-9]{4}(?![0-9])|(?<![0-9A-Za-z+.-])[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}(?![0-9.-])",
    "key": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}+|sk-[A-Za-z0-9_-]{20,}+)(?![A-Za-z0-9])",
    "token": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{20,}+={0,2}",
}
BASE = ("email", "ip", "card", "phone")
#: A match is looked for only in texts that hold this; it spares the others the slower pattern.
GATES = {"email": "@", "phone": "+", "ip": ".", "iban": None, "card": None, "ssn": "-", "tel": None, "key": None, "token": None}
#: Words near a span that raise or lower its score, fixed values; scores are from 0 to 1.
CONTEXT = {
    "email": (0.9, r"(?i)\b(e-?mail|contact|write)\b", r"(?i)\b(example|noreply)\b"),
    "ip": (0.6, r"(?i)\b(ip|host|server|address)\b", r"(?i)\b(version|section|chapter)\b"),
    "card": (0.7, r"(?i)\b(card|visa|credit|pay)\b", r"(?i)\b(isbn|order|serial)\b"),
    "phone": (0.6, r"(?i)\b(tel|phone|call|mobile|fax)\b", r"(?i)\b(part|serial)\b"),
    "iban": (0.8, r"(?i)\b(iban|bank|account|konto)\b", r"(?i)\b(serial)\b"),
    "ssn": (0.4, r"(?i)\b(ssn|social|security|insurance)\b", r"(?i)\b(order|part|serial)\b"),
    "tel": (0.6, r"(?i)\b(tel|phone|call|mobile|fax)\b", r"(?i)\b(order|part|serial|isbn)\b"),
    "key": (0.9, r"(?i)\b(key|secret|credentials?)\b", r"(?i)\b(example)\b"),
    "token": (0.4, r"(?i)(\b|_)(token|secret|passwor[dt]|passwd|pwd|api_?key|access_?key|credentials?|bearer)(\b|_)", r"(?i)\b(sha-?(1|256)|md5|checksum|commit|digest)\b"),
}
#: Characters of an IBAN by country; fixed values.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20,
    "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30,
    "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28,
    "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VG": 24, "XK": 20,
}
#: Pieces that one inner fold extends an array by.
FOLD = 128
#: Spans below this score are dropped, but for the base kinds, which stay.
MIN_SCORE = 0.5
NEAR = 40


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    values = F.transform(F.split(F.reverse(digits), ""), lambda c: F.when(c == "", 0).otherwise(c.cast("int")))
    doubled = F.transform(values, lambda v, i: F.when(i % 2 == 0, v).otherwise(2 * v - F.when(v > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + v) % 10 == 0


def _mod97(x: Column) -> Column:
    bare = F.replace(x, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(bare, F.lit(5)), F.substring(bare, 1, 4))
    codes = F.transform(F.split(turned, ""), lambda c: F.when(c == "", 0).otherwise(F.ascii(c)))
    step = lambda a, v: F.when(v >= 65, (a * 100 + v - 55) % 97).when(v >= 48, (a * 10 + v - 48) % 97).otherwise(a)
    return F.aggregate(codes, F.lit(0), step) == 1


def _let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _iban_end(match: Column) -> Column:
    """Characters of the IBAN at the start of the match, by its country's length; 0 where it is too short or goes on."""
    length = F.get(F.map_values(F.map_filter(_IBAN_MAP(), lambda k, v: k == F.substring(match, 1, 2))), F.lit(0))
    own = F.call_function("regexp_extract", match, F.concat(F.lit("^(?:\\x20?[A-Z0-9]){"), F.coalesce(length, F.lit(34)).cast("string"), F.lit("}(?=\\x20|$)")), F.lit(0))
    return F.length(own)


def _IBAN_MAP() -> Column:
    return F.create_map(*(F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair))


def _confirmed(kind: str, match: Column) -> Column:
    """How many characters of the match its kind's checks confirm; 0 for none."""
    whole = lambda ok: F.when(ok, F.length(match)).otherwise(0)
    if kind == "ip":
        return whole(match.rlike(r"^(?:0*+(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"))
    if kind == "card":
        return whole(_let(_digits(match), lambda d: F.when((F.length(d) >= 12) & (F.length(d) <= 19), _luhn(d)).otherwise(False)))
    if kind == "phone":
        return whole(F.length(_digits(match)).between(9, 15))
    if kind == "iban":
        return _let(_iban_end(match), lambda n: F.when((n > 0) & _mod97(F.substr(match, F.lit(1), n)), n).otherwise(0))
    if kind == "ssn":
        return whole(~match.rlike("^(000|666|9)") & ~match.rlike("-00-") & ~match.rlike("-0000$"))
    return F.length(match)


_SPAN = "struct<start:int,rank:int,end:int,kind:string,score:double>"


def _blocks(rows: Column) -> Column:
    """An array cut into arrays of FOLD elements."""
    return _let(rows, lambda r: F.when(F.size(r) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(r) - 1) / FOLD).cast("int")), lambda b: F.slice(r, b * FOLD + 1, F.lit(FOLD)))).otherwise(F.slice(F.array(r), 1, 0)))


def _spans(text: Column, kind: str, rank: int) -> Column:
    """The confirmed spans of one kind: array of (start, rank, end, kind, score); empty without matches."""
    base, near, against = CONTEXT[kind]
    none = F.array().cast(f"array<{_SPAN}>")
    piece = lambda p, i: F.struct(
        F.when(i == 0, "").otherwise(F.substring_index(p, CLOSE, 1)).alias("m"),
        F.when(i == 0, p).otherwise(F.substr(p, F.length(F.substring_index(p, CLOSE, 1)) + 2)).alias("rest"),
    )
    sized = lambda c: F.struct(
        c["m"].alias("m"), F.length(c["m"]).alias("n"), F.length(c["rest"]).alias("after"), F.substr(c["rest"], F.lit(1), F.lit(NEAR)).alias("tail"), F.right(c["rest"], F.lit(NEAR)).alias("head")
    )

    def described(c: Column, head: Column) -> Column:
        """Lengths of a piece's match and rest, the match's confirmed length, and its score by the words before and behind it."""
        around = F.concat_ws(" ", head, c["tail"])
        score = F.lit(base) + F.when(around.rlike(near), 0.2).otherwise(0.0) - F.when(around.rlike(against), 0.3).otherwise(0.0)
        sure = F.when(c["n"] > 0, _confirmed(kind, c["m"])).otherwise(0)
        return F.struct(c["n"].alias("n"), c["after"].alias("after"), sure.alias("sure"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"))

    def step(a: Column, c: Column) -> Column:
        keep = c["sure"] > 0 if kind in BASE else (c["sure"] > 0) & (c["score"] >= MIN_SCORE)
        span = F.struct(a["at"].alias("start"), F.lit(rank).alias("rank"), (a["at"] + c["sure"]).alias("end"), F.lit(kind).alias("kind"), c["score"].alias("score"))
        return F.struct((a["at"] + c["n"] + c["after"]).alias("at"), F.when(keep, F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

    def block(a: Column, pieces: Column) -> Column:
        inner = F.aggregate(pieces, F.struct(a["at"].alias("at"), none.alias("out")), step)
        return _let(inner, lambda x: F.struct(x["at"].alias("at"), F.concat(a["out"], F.array(x["out"])).alias("out")))

    def folded(pieces: Column) -> Column:
        rows = _let(F.transform(F.transform(pieces, piece), sized), lambda s: F.zip_with(s, F.slice(F.concat(F.array(F.lit("")), F.transform(s, lambda x: x["head"])), F.lit(1), F.size(s)), described))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{_SPAN}>>").alias("out"))
        return F.flatten(F.aggregate(_blocks(rows), start, block, lambda a: a["out"]))

    marked = F.split(F.regexp_replace(text, PATTERNS[kind], f"{OPEN}$0{CLOSE}"), OPEN, -1)
    found = _let(marked, lambda p: F.when(F.size(p) > 1, folded(p)).otherwise(none))
    return F.when(F.contains(text, F.lit(GATES[kind])), found).otherwise(none) if GATES[kind] else found


def find(docs: DataFrame, kinds=tuple(PATTERNS)) -> DataFrame:
    """docs with `pii_spans`: array of (start, rank, end, kind, score), by start and then kind as listed.

    Positions are code points, ends exclusive, of the whole text; null or empty text has none. The kinds' spans may
    overlap one another, not within a kind. Other columns and repeated rows pass unchanged; a column pii_spans is replaced.
    """
    docs = docs.drop("pii_spans")
    clean, *own = unused(docs, "clean", *kinds)
    marks = F.translate(F.coalesce("text", F.lit("")), OPEN + CLOSE, OTHER + OTHER)
    order = list(PATTERNS)
    found = docs.withColumn(clean, marks).withColumns({c: _spans(F.col(clean), k, order.index(k)) for c, k in zip(own, kinds)})
    return found.withColumn("pii_spans", F.array_sort(F.concat(*map(F.col, own)))).drop(clean, *own)


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, the counts and digest of the base kinds, all spans, and their scores in the same order, two digits each."""
    found = find(docs.select("doc_id", "text")).select("doc_id", "pii_spans")
    base = F.filter("pii_spans", lambda s: s["rank"] < len(BASE))
    count = lambda k: F.size(F.filter("pii_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    scores = F.array_join(F.transform("pii_spans", lambda s: F.format_number(s["score"], 2)), ",")
    return found.select("doc_id", *map(count, BASE), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("pii_spans")).alias("spans"), scores.alias("scores"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of `text` replaced by [KIND]; overlapping spans give the tag of the first.

    Null text stays null; texts without spans are unchanged. n_chars, where there is such a column, follows the text; the other
    columns stay, whatever their names.
    """
    names, text = docs.columns, F.col("text")
    (spans,) = unused(docs, "spans")
    clash = [n for n in names if n.lower() == "pii_spans"]
    found = find(docs.withColumnsRenamed({n: f"{spans}_own" for n in clash})).withColumnRenamed("pii_spans", spans)
    found = found.withColumnsRenamed({f"{spans}_own": n for n in clash})

    def block(a: Column, some: Column) -> Column:
        """Appends a block's replaced stretch; substrings are taken from that stretch alone."""
        part = F.substr(text, a["at"] + 1, F.greatest(F.array_max(F.transform(some, lambda s: s["end"])) - a["at"], F.lit(0)))

        def inside(p: Column) -> Column:
            def step(x: Column, s: Column) -> Column:
                new = F.array(F.substr(p, x["at"] - a["at"] + 1, s["start"] - x["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
                over = s["start"] < x["at"]
                return F.struct(F.greatest(x["at"], s["end"]).alias("at"), F.when(over, x["out"]).otherwise(F.concat(x["out"], new)).alias("out"))

            return F.aggregate(some, F.struct(a["at"].alias("at"), F.array().cast("array<string>").alias("out")), step)

        return _let(_let(part, inside), lambda x: F.struct(x["at"].alias("at"), F.concat(a["out"], F.array(F.concat_ws("", x["out"]))).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    cut = F.aggregate(_blocks(F.col(spans)), start, block, lambda a: F.concat(F.concat_ws("", a["out"]), F.substr(text, a["at"] + 1)))
    out = found.withColumn("text", F.when(F.size(spans) > 0, cut).otherwise(text))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*named(names))
