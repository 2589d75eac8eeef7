r"""Operator 3: personal data by weak supervision, in Spark expressions only.

Four kinds have fixed patterns (email, ip, card, phone); their spans are found as written and
always stay. Spans of further kinds (EXTRA_KINDS) start as candidates of a loose pattern and are
judged by labelers, which look at different things: a regular expression for the strict layout of
the kind, a gazetteer of words that announce it nearby, its immediate context (assignment, colon,
quotes, postal code) and the make-up of its characters. Votes of all candidates are counted by
pattern; expectation-maximisation over those counts estimates each labeler's reliability, and the
posterior of each pattern trains a logistic span classifier on votes, kind and shape features.
Candidates it accepts become spans, unless a base span covers them.

The pattern table has at most PATTERNS rows whatever the input, so the driver may hold it; all
else is columns. Positions come from the lengths of what lies between matches, in code points.
Labelers look at NEAR_BEFORE characters before a candidate and NEAR_AFTER after it (parameters).

Texts are cut with patterns that no long run can slow down or overflow: a joining character
(. within a domain, one space or hyphen between digits) is first turned, in place, into U+0003,
after any U+0003 of the text became U+0004. Then every repetition is of a single class, and a
match is tried only where a run begins or where the last match ended.

Defined results: null is the empty text, which has no spans. Repeated rows are judged each. No
candidates leave the base spans. A candidate of any length is judged whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import let, running_ends, running_max
from .common import free_name, read_table, text_or_empty, written

BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("secret", "account", "national_id", "name", "address")
LABELERS = ("layout", "gazetteer", "context", "mix")
FEATURES = (*LABELERS, "long", *EXTRA_KINDS)
PATTERNS = 2 ** len(LABELERS) * 2 * len(EXTRA_KINDS)
#: Characters looked at before and after a candidate.
NEAR_BEFORE, NEAR_AFTER = 48, 16
#: Loose patterns of the further kinds. Names need a title, addresses a number and a word for a way.
CANDIDATES = {
    "secret": r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{16,}+",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+(?![A-Za-z0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "name": r"(?<!\p{L})(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.? \p{Lu}\p{L}{1,30}+(?: \p{Lu}\p{L}{1,30}+)?",
    "address": r"(?<!\p{L})(?:[0-9]{1,5} \p{Lu}\p{L}{1,30}+ (?:Street|Avenue|Road|Lane|Boulevard|Drive)|\p{Lu}\p{L}{2,30}(?:straße|gasse|weg) [0-9]{1,4}+|[0-9]{1,5},? (?:rue|avenue|calle) \p{L}{2,30}+)",
}
#: A strict layout of each kind: common key lengths and prefixes, lengths of account numbers, number areas in use, two-part names, capitals or a comma after the way.
LAYOUTS = {
    "secret": r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{20,})",
    "account": r"^(?:DE[0-9]{20}|FR[0-9]{12}[A-Z0-9]{11}[0-9]{2}|ES[0-9]{22}|GB[0-9]{2}[A-Z]{4}[0-9]{14}|NL[0-9]{2}[A-Z]{4}[0-9]{10}|IT[0-9]{2}[A-Z][0-9]{22})$",
    "national_id": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "name": r" \p{Lu}\p{L}+ \p{Lu}\p{L}+$",
    "address": r"^(?:[0-9]{1,5} \p{Lu}\p{L}+ (?:Street|Avenue|Road|Lane|Boulevard|Drive)|\p{Lu}\p{L}+(?:straße|gasse|weg) [0-9]+)$",
}
#: Words that announce each kind, in lower case.
GAZETTEER = {
    "secret": ("token", "secret", "passwd", "password", "pwd", "api", "key", "auth", "bearer", "credential", "private", "session"),
    "account": ("iban", "account", "bank", "konto", "compte", "cuenta", "transfer", "pay"),
    "national_id": ("ssn", "social", "security", "national", "insurance", "tax", "identity"),
    "name": ("dear", "signed", "contact", "patient", "employee", "regards", "tenant", "sehr geehrte", "cher", "estimad"),
    "address": ("address", "lives", "residence", "ship", "deliver", "anschrift", "wohnt", "adresse", "dirección"),
}
#: What stands right before or after each kind.
CONTEXT_BEFORE = {"secret": r"""[=:]\s*["']?$""", "account": r"[:#]\s*$", "national_id": r"[:#]\s*$", "name": r"(?:[:,]\s*|^\s*)$", "address": r"[:,]\s*$"}
CONTEXT_AFTER = {"secret": r"""^["'](?:\W|$)""", "account": r"^\s*(?:BIC|\()", "national_id": r"^\s*(?:[,;.]|$)", "name": r"^(?:,|'s|\s+(?:born|lives|called|said))", "address": r"^,?\s*(?:[0-9]{4,5}|\p{Lu})"}
SPAN = "struct<kind:string,start:int,end:int>"
JOIN = "\x03"


def _spans(kind: str, text: Column, pattern: str) -> Column:
    """Spans of all matches, leftmost and apart."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    sizes = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("size")))
    one = lambda s, end: F.struct(F.lit(kind).alias("kind"), (end - s["size"]).alias("start"), end.alias("end"))
    return let(sizes, lambda all_sizes: F.zip_with(all_sizes, running_ends(F.transform(all_sizes, lambda s: s["gap"] + s["size"])), one))


def _inside(text: Column, span: Column) -> Column:
    return F.substr(text, span["start"] + 1, span["end"] - span["start"])


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    values = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: (v := c.cast("int") * (1 + i % 2)) - F.when(v > 9, 9).otherwise(0))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def _small_parts(c: Column) -> Column:
    return F.forall(F.split(c, r"\."), lambda p: (F.length(q := F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.when(q == "", 0).otherwise(F.substring(q, 1, 3).cast("int")), F.lit(0)) <= 255))


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of the four kinds, for a text without nulls."""
    plain = F.translate(text, JOIN, "\x04")
    dotted = F.regexp_replace(plain, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", JOIN)
    joined = F.regexp_replace(plain, r"(?<=[0-9])[ -](?=[0-9])", JOIN)
    email = r"(?:(?<![A-Za-z0-9._%+\x03-])|\G)[A-Za-z0-9._%+\x03-]++@[A-Za-z0-9-]++\x03[A-Za-z0-9\x03-]++"
    ip = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
    card = r"(?<![0-9\x03])[0-9\x03]{13,37}(?![0-9\x03])"
    phone = r"\+[0-9][ ().0-9-]+[0-9]"
    none = F.array().cast(f"array<{SPAN}>")
    n_digits = lambda s: F.length(_digits(_inside(text, s)))
    return {
        "email": F.when(F.instr(text, "@") > 0, _spans("email", dotted, email)).otherwise(none),
        "ip": F.when(text.rlike(r"[0-9]\.[0-9]"), F.filter(_spans("ip", text, ip), lambda s: _small_parts(_inside(text, s)))).otherwise(none),
        "card": F.when(text.rlike("[0-9][ -]?[0-9][ -]?[0-9]"), F.filter(_spans("card", joined, card), lambda s: n_digits(s).between(13, 19) & _luhn(_digits(_inside(text, s))))).otherwise(none),
        "phone": F.when(F.instr(text, "+") > 0, F.filter(_spans("phone", text, phone), lambda s: n_digits(s).between(9, 15))).otherwise(none),
    }


def _pattern(text: Column, kind: str, span: Column, near_before: int, near_after: int) -> Column:
    """Votes (a bit each, in the order of LABELERS), a bit for length, and the kind's number, as one number."""
    body = _inside(text, span)
    before = F.substr(text, F.greatest(F.lit(1), span["start"] + 1 - near_before), F.least(F.lit(near_before), span["start"]))
    after = F.substr(text, span["end"] + 1, F.lit(near_after))
    kinds_of_characters = sum((body.rlike(c).cast("int") for c in ("[0-9]", "[a-z]", "[A-Z]")), F.lit(0))
    mixed = {
        "secret": (kinds_of_characters >= 2) & body.rlike("[0-9]") & (F.length(F.regexp_replace(body, "[^0-9]", "")) * 8 >= F.length(body)),
        "account": F.length(_digits(body)) * 2 >= F.length(body),
        "national_id": F.size(F.array_distinct(F.split(_digits(body), ""))) >= 4,
        "name": F.length(body).between(8, 40),
        "address": F.length(body).between(8, 60),
    }[kind]
    votes = (
        body.rlike(LAYOUTS[kind]),
        F.lower(before).rlike("|".join(GAZETTEER[kind])),
        before.rlike(CONTEXT_BEFORE[kind]) | after.rlike(CONTEXT_AFTER[kind]),
        mixed,
        F.length(body) >= 32,
    )
    bits = sum((F.when(v, 1 << k).otherwise(0) for k, v in enumerate(votes)), F.lit(0))
    return bits + F.lit(EXTRA_KINDS.index(kind) << len(votes))


def bits_of(pattern: int) -> list[int]:
    """The features of a pattern, in the order of FEATURES."""
    votes = [pattern >> k & 1 for k in range(len(LABELERS) + 1)]
    return votes + [int(k == pattern >> len(votes)) for k in range(len(EXTRA_KINDS))]


def with_candidates(docs: DataFrame, text: str = "text", base: str = "base", extra: str = "extra", near_before: int = NEAR_BEFORE, near_after: int = NEAR_AFTER) -> DataFrame:
    """docs with two columns: base (spans of the fixed kinds) and extra (span and pattern of each candidate that no base span covers)."""
    body = text_or_empty(text)
    found = docs.withColumn(base, F.concat(*base_spans(body).values()))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,pattern:int>>")
    #: Cheap tests that a text must pass before a kind's pattern goes through it.
    first = {"secret": body.rlike("[A-Za-z0-9_+/=-]{16}"), "account": body.rlike("[A-Z]{2}[0-9]{2}[A-Z0-9]{11}"), "national_id": body.rlike("[0-9]-[0-9]{2}-[0-9]"), "name": body.rlike(r"[rsfeañ]\.? \p{Lu}") & body.rlike(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor)"), "address": body.rlike(r"[0-9]") & body.rlike(r"Street|Avenue|Road|Lane|Boulevard|Drive|straße|gasse|weg|rue|avenue|calle")}

    def judged(kind: str) -> Column:
        covered = lambda e: F.exists(base, lambda b: (e["start"] >= b["start"]) & (e["end"] <= b["end"]))
        row = lambda e: F.struct(e["kind"].alias("kind"), e["start"].alias("start"), e["end"].alias("end"), _pattern(body, kind, e, near_before, near_after).alias("pattern"))
        return F.when(first[kind], F.transform(F.filter(_spans(kind, body, CANDIDATES[kind]), lambda e: ~covered(e)), row)).otherwise(none)

    return found.withColumn(extra, F.concat(*map(judged, EXTRA_KINDS)))


def reliabilities(counts: dict[int, int], rounds: int = 60) -> tuple[dict[int, float], list[tuple[float, float]]]:
    """By expectation-maximisation: the chance that a pattern is private, and each labeler's (hit rate, false rate)."""
    votes = {p: bits_of(p)[: len(LABELERS)] for p in counts}
    total = sum(counts.values())
    share, rates = 0.5, [(0.8, 0.2)] * len(LABELERS)
    chance = dict.fromkeys(counts, 0.5)
    for _ in range(rounds):
        for p, v in votes.items():
            yes, no = math.log(share), math.log(1 - share)
            for x, (hit, false) in zip(v, rates):
                yes += math.log(hit if x else 1 - hit)
                no += math.log(false if x else 1 - false)
            chance[p] = 1 / (1 + math.exp(min(60.0, no - yes)))
        n_yes = sum(counts[p] * chance[p] for p in counts)
        share = (n_yes + 1) / (total + 2)
        # Two counts of belief in the start values keep labelers better than chance when data are few.
        rates = [
            ((sum(counts[p] * chance[p] * v[k] for p, v in votes.items()) + 1.6) / (n_yes + 2), (sum(counts[p] * (1 - chance[p]) * v[k] for p, v in votes.items()) + 0.4) / (total - n_yes + 2))
            for k in range(len(LABELERS))
        ]
    return chance, rates


def trained(counts: dict[int, int], steps: int = 400) -> list[float]:
    """Weights of the span classifier (the last is the offset), from the patterns' posteriors."""
    chance, _ = reliabilities(counts)
    rows = [(bits_of(p) + [1], n, chance[p]) for p, n in sorted(counts.items())]
    total = sum(n for _, n, _ in rows)
    weights = [0.0] * (len(FEATURES) + 1)
    for _ in range(steps):
        slope = [0.002 * w for w in weights]
        for x, n, y in rows:
            z = sum(w * v for w, v in zip(weights, x))
            error = (1 / (1 + math.exp(-max(-40.0, min(40.0, z)))) - y) * n / total
            slope = [s + error * v for s, v in zip(slope, x)]
        weights = [w - 2.0 * s for w, s in zip(weights, slope)]
    return weights


def fit(candidates: DataFrame, extra: str = "extra") -> list[float]:
    """The classifier for what with_candidates() gave. At most PATTERNS counts come to the driver."""
    rows = candidates.select(F.explode(F.col(f"{extra}.pattern")).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n")).collect()
    counts = {r["pattern"]: r["n"] for r in rows}
    return trained(counts) if counts else [0.0] * len(FEATURES) + [-1.0]


def accepted(weights: list[float]) -> list[int]:
    """The patterns that the classifier takes for private."""
    return [p for p in range(PATTERNS) if weights[-1] + sum(w for w, v in zip(weights, bits_of(p)) if v) >= 0]


def all_spans(weights: list[float], base: str = "base", extra: str = "extra") -> Column:
    """Base spans and accepted candidates of with_candidates(), by kind and then start."""
    right = F.array(*map(F.lit, accepted(weights) or [-1]))
    kept = F.filter(extra, lambda e: F.array_contains(right, e["pattern"]))
    return F.concat(base, F.transform(kept, lambda e: F.struct(e["kind"].alias("kind"), e["start"].alias("start"), e["end"].alias("end"))))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span (overlapping ones as one, of the first's kind) replaced by its kind in brackets."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    # A span's piece is the gap since the furthest end before it, and its mark unless it begins before that end.
    furthest = lambda all_spans: F.concat(F.array(F.lit(0)), running_max(F.transform(all_spans, lambda s: s["end"])))

    def pieces(all_spans: Column, ends: Column) -> Column:
        mark = lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        piece = lambda s, k: let(F.get(ends, k), lambda at: F.when((s["start"] < at), "").otherwise(F.concat(F.substr(text, at + 1, s["start"] - at), mark(s))))
        rest = F.substr(text, F.element_at(ends, -1) + 1, F.length(text))
        return F.concat(F.array_join(F.transform(all_spans, piece), ""), rest)

    made = let(ordered, lambda all_spans: let(furthest(all_spans), lambda ends: pieces(all_spans, ends)))
    return F.when(F.size(spans) == 0, text).otherwise(made)


def without_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs, same columns, with spans redacted. Texts are gone through twice: to count votes, and to redact."""
    weights = fit(with_candidates(docs.select(F.col(text).alias("text"))))
    base, extra = free_name(docs, "base"), free_name(docs, "extra")
    found = with_candidates(docs, text, base, extra)
    return found.withColumn(text, F.when(F.col(text).isNotNull(), redacted(text_or_empty(text), all_spans(weights, base, extra)))).drop(base, extra)


def _listed(spans: Column | str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = written(with_candidates(docs).drop("text"), "spans")  # so that texts are gone through once
    number_of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = {f"n_{k}": number_of(k) for k in BASE_KINDS}
    return found.select("doc_id", *(c.alias(n) for n, c in counts.items()), F.sha2(_listed("base"), 256).alias("base_sha256"), _listed(all_spans(fit(found))).alias("spans"))
