"""Personal data (operator 3), native expressions only.

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod 97 for IBANs), and words
nearby move the score. The base kinds are email, ip, card and phone; a base span that passes its check
stays whatever its score. IBANs, and where the context speaks for them US social security numbers and
secrets (long hexadecimal or mixed runs, as keys and tokens are), come on top. Secrets whose form alone
tells them, as the prefixes of some providers' keys do, need no context.

The patterns use possessive runs and look-behinds instead of the plain forms of the same languages, so
that no text makes the matcher recurse deeply or rescan a run: an attempt inside a run of an address's
local part or of digits fails just when the attempt at the run's start does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mattelake.llm.common import renamed, restored

_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "secret")
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,256}+(?![A-Za-z0-9_+/-])",
}
#: What a text must contain before a pattern is tried.
MARKS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.65, "ssn": 0.4, "secret": 0.4}
#: Beginnings of keys that name themselves; such a secret has the score of an e-mail address.
KEY_HEADS = r"^(AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|xox[abprs]-|sk-|sk_live_|AIza|eyJ)"

FOR = {
    "email": r"(?i)\b(e-?mail|mail|contact|write)\b",
    "ip": r"(?i)\b(ip|host|server|address|login)\b",
    "card": r"(?i)\b(card|visa|mastercard|amex|credit|debit|pay(ment)?)\b",
    "phone": r"(?i)\b(phone|tel|call|mobile|fax|whatsapp)\b",
    "iban": r"(?i)\b(iban|account|bank|konto|transfer)\b",
    "ssn": r"(?i)\b(ssn|social security)\b",
    "secret": r"(?i)(token|secret|passw(or)?d|passwd|pwd|credential|bearer|(api|access|private|auth)[ _-]?key|\bkey)\b",
}
AGAINST = r"(?i)\b(version|release|isbn|invoice|order|example|serial|sku|build)\b"
BONUS, MALUS, LEAST = 0.2, 0.2, 0.5
#: Code points of context before and after a span.
BEFORE, AFTER = 40, 24


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    digits = F.split(F.reverse(_digits(match)), "")
    doubled = F.transform(digits, lambda c, i: c.cast("int") * (1 + i % 2))
    return F.aggregate(doubled, F.lit(0), lambda s, x: s + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0


def _mod97(match: Column) -> Column:
    plain = F.regexp_replace(match, " ", "")
    chars = F.split(F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4))), "")
    value = lambda c: F.when(c < "A", F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(chars, F.lit(0), lambda s, c: (s * F.when(c < "A", 10).otherwise(100) + value(c)) % 97) == 1


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return _luhn(match)
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        return _mod97(match)
    if kind == "ssn":
        return ~match.rlike("^(000|666|9..)-|-00-|-0000$")
    if kind == "secret":
        # Words joined by dashes or slashes, and plain numbers, are none.
        return match.rlike("[0-9]") & match.rlike("[A-Za-z]") & (match.rlike("^[0-9a-f]+$|^[0-9A-F]+$") | (match.rlike("[0-9].*[A-Za-z].*[0-9]") & match.rlike("[A-Z]") & match.rlike("[a-z]")) | match.rlike(KEY_HEADS))
    return F.lit(True)


def _proposals(kind: str, text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    none = F.array().cast("array<string>")
    return F.when(F.contains(text, F.lit(MARKS[kind])), found).otherwise(none) if kind in MARKS else found


#: Matches that are placed in one fold; only bounds the copying of growing arrays.
FOLD = 256


def _items(kind: str, text: Column, matches: Column) -> Column:
    """gap (code points since the match before), size, validity and score of every match.

    The context of a match is the end of the piece before it and the beginning of the piece behind it.
    """
    n = F.size(matches)
    pieces = F.split(text, PATTERNS[kind])

    def item(p, x):
        near = F.concat(F.substring(p, -BEFORE, BEFORE), F.lit(" "), x["h"])
        return F.struct(F.length(p).alias("gap"), F.length(x["m"]).alias("size"), _valid(kind, x["m"]).alias("valid"), _score(kind, x["m"], near).alias("score"))

    heads = F.transform(F.slice(pieces, F.lit(2), n), lambda p: F.substring(p, 1, AFTER))
    return F.zip_with(F.slice(pieces, F.lit(1), n), F.zip_with(matches, heads, lambda m, h: F.struct(m.alias("m"), F.coalesce(h, F.lit("")).alias("h"))), item)


def _folds(items: Column) -> Column:
    whole = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / FOLD).cast("int"))
    return F.when(F.size(items) > 0, F.transform(whole, lambda i: F.slice(items, i * FOLD + 1, F.lit(FOLD))))


def _starts(folds: Column) -> Column:
    widths = F.transform(folds, lambda f: F.aggregate(f, F.lit(0), lambda s, x: s + x["gap"] + x["size"]))
    return F.aggregate(widths, F.array(F.lit(0)), lambda acc, w: F.concat(acc, F.array(F.element_at(acc, -1) + w)))


def _spans(kind: str, folds: Column, starts: Column) -> Column:
    """Confirmed spans, scored. Starts are running sums over gaps and sizes.

    Appending to an array copies it, so the sums run in folds of ``FOLD`` matches whose own starts come first.
    """
    rank = F.lit(KINDS.index(kind))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,score:double>>")

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + x["size"]
        own = F.array(F.struct(start.alias("start"), rank.alias("rank"), end.alias("end"), x["score"].alias("score")))
        return F.struct(end.alias("at"), F.when(x["valid"], F.concat(acc["out"], own)).otherwise(acc["out"]).alias("out"))

    def one(fold, start):
        return F.aggregate(fold, F.struct(start.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    out = F.flatten(F.zip_with(folds, F.slice(starts, F.lit(1), F.size(folds)), one))
    kept = out if kind in BASE else F.filter(out, lambda x: x["score"] >= LEAST)
    return F.when(F.size(folds) > 0, kept).otherwise(none)


def _score(kind: str, match: Column, near: Column) -> Column:
    base = F.lit(SCORES[kind])
    if kind == "secret":
        base = F.when(match.rlike(KEY_HEADS), SCORES["email"]).otherwise(base)
    score = base + F.when(near.rlike(FOR[kind]), BONUS).otherwise(0.0) - F.when(near.rlike(AGAINST), MALUS).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2)


def find_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs and ``pii``, array<struct<start, rank, end, score>> by start, then kind (rank in ``KINDS``).

    Positions are code points, the end exclusive. A null or empty text has none. A text of any length is
    scanned whole, in place: rows, repeated ones too, and other columns pass through under their own names;
    only a column named ``pii`` is replaced.
    """
    safe, new = renamed(docs.drop("pii"))
    out = safe.withColumn("whole", F.coalesce(F.col(new[text]), F.lit("")))
    out = out.withColumns({f"found_{k}": _proposals(k, F.col("whole")) for k in KINDS})
    # A column for each step: what the next one reads more than once is worked out once.
    none = F.array().cast("array<struct<gap:int,size:int,valid:boolean,score:double>>")
    out = out.withColumns({f"items_{k}": F.when(F.size(f"found_{k}") > 0, _items(k, F.col("whole"), F.col(f"found_{k}"))).otherwise(none) for k in KINDS})
    out = out.withColumns({f"folds_{k}": _folds(F.col(f"items_{k}")) for k in KINDS})
    out = out.withColumns({f"starts_{k}": _starts(F.col(f"folds_{k}")) for k in KINDS})
    pii = F.array_sort(F.concat(*[_spans(k, F.col(f"folds_{k}"), F.col(f"starts_{k}")) for k in KINDS]))
    # The condition always holds; it keeps a caller's filter on pii from being pushed below the steps, each of which it would repeat.
    return out.withColumn("pii", F.when(F.monotonically_increasing_id() >= 0, pii)).select(*restored(new), "pii")


def _line(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["start"], x["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores."""
    found = find_spans(docs.select("doc_id", "text"))
    base = F.filter("pii", lambda x: x["rank"] < len(BASE))
    count = lambda i: F.size(F.filter("pii", lambda x: x["rank"] == i)).cast("long")
    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(_line(base), 256).alias("base_sha256"), _line(F.col("pii")).alias("spans"), F.array_join(F.transform("pii", lambda x: x["score"].cast("string")), ",").alias("scores"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of ``text`` replaced by its kind in brackets; of overlapping spans the first."""
    names = docs.columns
    found = find_spans(docs, text)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(acc, x):
        new = F.struct(x["end"].alias("at"), F.concat(acc["out"], F.substr(F.col(text), acc["at"] + 1, x["start"] - acc["at"]), F.get(kinds, x["rank"])).alias("out"))
        return F.when(x["start"] >= acc["at"], new).otherwise(acc)

    done = F.aggregate("pii", start, step, lambda acc: F.concat(acc["out"], F.substr(F.col(text), acc["at"] + 1)))
    return found.withColumn(text, F.when(F.size("pii") > 0, done).otherwise(F.col(text))).select(*names)
