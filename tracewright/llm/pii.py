"""Personal data by weak supervision, DataFrame functions only.

Base patterns find e-mail addresses, IPv4 addresses, card and phone numbers. Wider patterns propose more spans (as cards
only numbers with a right check digit); regex, gazetteer and context labelers vote on each; expectation-maximisation over the counts of their vote patterns
estimates how reliable each labeler is, the base spans being known cases; and a logistic span classifier trained on the
resulting probabilities decides which proposals are added. Base spans always stay.

Defined results: null text counts as empty and has no spans; repeated rows are handled once per row; where nothing is
proposed nothing is added; columns other than the text are kept by ``find`` as they are, but for ``base``, ``spans`` and
``proposed``, whose place it takes; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import materialize

KINDS = ["email", "ip", "card", "phone"]

#: The base patterns, written so that the scan is linear: an attempt starts only where a run of its characters does (or
#: where the last match ended), and nothing that can't matter is tried again. Cards: whole runs of 16 to 19 digits.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Proposals: numbers written in groups or at length, and addresses with the sign spelt out.
NUMBER = r"(?<![A-Za-z0-9+._@(-])\(?[0-9][0-9 ().-]{5,22}[0-9](?![A-Za-z0-9_@])"
SPELT = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+ ?[(\[](?:at|AT)[)\]] ?[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,8}+"

#: Labelers. Context is looked for in the characters before a span.
CONTEXT = 40
CUES = {
    "email": r"e-?mails?|contact|write to|reply",
    "card": r"cards?|visa|mastercard|amex|credit|debit|payment|paid with",
    "phone": r"phones?|call|tel|mobile|fax|whatsapp|contact|dial|text me",
}
AGAINST = r"version|release|isbn|page|chapter|order|invoice|total|table|figure|ratio|score|token|key|hash|licen[sc]e|copyright|since"
#: Gazetteers: issuer prefixes of cards, shapes of national phone numbers, and endings of mail domains.
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|62)"
PHONE_SHAPE = r"^(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}$|^0[0-9]{2,4}[ -][0-9]{3,4}[ -]?[0-9]{3,4}$"
MAIL_ENDS = r"\.(?:com|org|net|edu|gov|io|de|fr|es|uk|eu)$"
DATES = r"(?:19|20)[0-9]{2}[ .-][0-9]{1,2}[ .-][0-9]{1,2}|[0-9]{1,2}[ .-][0-9]{1,2}[ .-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2} ?- ?(?:19|20)[0-9]{2}"
LABELERS = ["shape", "gazetteer", "context", "against"]


def _sql(s: str) -> str:
    return "r'" + s.replace("'", "\\'") + "'"


def _spans(matches: str, gaps: str) -> Column:
    """Start, end, text and the text before, of each match: the text is gap, match, gap, match, ..., gap. What stands
    before a match may reach over earlier ones."""
    return F.expr(f"""
      aggregate(
        zip_with(slice({gaps}, 1, size({matches})), {matches}, (g, m) -> named_struct('gap', g, 'match', m)),
        named_struct('out', cast(array() as array<struct<start:int, `end`:int, before:string, value:string>>), 'at', 0, 'tail', ''),
        (a, x) -> named_struct(
          'out', concat(a.out, array(named_struct('start', a.at + length(x.gap), 'end', a.at + length(x.gap) + length(x.match),
            'before', lower(right(concat(a.tail, right(x.gap, {CONTEXT})), {CONTEXT})), 'value', x.match))),
          'at', a.at + length(x.gap) + length(x.match),
          'tail', right(concat(a.tail, right(x.gap, {CONTEXT}), right(x.match, {CONTEXT})), {CONTEXT})),
        a -> a.out)""")


def _matched(df: DataFrame, text: str, name: str, pattern: str, needs: str | None) -> DataFrame:
    """``df`` with the spans of a pattern in column ``name``; offsets count code points."""
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    none = F.array().cast("array<string>")
    df = df.withColumn("__pii_m", F.when(F.contains(F.col(text), F.lit(needs)), found).otherwise(none) if needs else found)
    df = df.withColumn("__pii_g", F.when(F.size("__pii_m") > 0, F.split(F.col(text), pattern, -1)).otherwise(none))
    return df.withColumn(name, _spans("__pii_m", "__pii_g")).drop("__pii_m", "__pii_g")


_digits = "regexp_replace(x.value, '[^0-9]', '')"
_valid = {
    "email": "true",
    "ip": r"forall(split(x.value, '[.]'), p -> coalesce(try_cast(p as int), 256) <= 255)",
    "card": f"luhn_check({_digits})",
    "phone": f"length({_digits}) between 8 and 15",
}


def _proposal(kind: str, base: bool) -> str:
    """The labelers' votes (1 for, -1 against, 0 none) and the features of span x."""
    shape = {
        "email": "1",
        "card": f"case when x.value rlike '^[0-9]{{13,19}}$' or x.value rlike '^[0-9]{{4}}([ -])[0-9]{{4,6}}([ -])[0-9]{{4,5}}([ -]?[0-9]{{4}})?$' then 1 else -1 end",
        "phone": f"case when x.value rlike {_sql(PHONE_SHAPE)} or x.value like '+%' then 1 when x.value rlike '^[0-9]+$' then 0 else -1 end",
    }[kind]
    gazetteer = {
        "email": f"case when lower(x.value) rlike {_sql(MAIL_ENDS)} then 1 else 0 end",
        "card": f"case when {_digits} rlike {_sql(ISSUERS)} then 1 else -1 end",
        "phone": f"case when x.value rlike {_sql(DATES)} then -1 else 0 end",
    }[kind]
    context = f"case when x.before rlike {_sql(rf'(?:^|[^a-z])(?:{CUES[kind]})(?:[^a-z]|$)')} then 1 else 0 end"
    against = f"case when x.before rlike {_sql(rf'(?:^|[^a-z])(?:{AGAINST})(?:[^a-z]|$)')} or x.before rlike {_sql(r'[=#]\s*\S?$')} then -1 else 0 end"
    size = f"length({_digits})" if kind != "email" else "0"
    groups = r"size(split(x.value, '[ ().-]+'))"
    return (
        f"named_struct('kind', '{kind}', 'start', x.start, 'end', x.`end`, 'base', {str(base).lower()}, 'shape', {shape}, "
        f"'gazetteer', {gazetteer}, 'context', {context}, 'against', {against}, 'digits', {size}, 'groups', least({groups}, 6))"
    )


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base`` (kind, start, end of the base spans) and ``proposed`` (these and the wider patterns'
    spans, with votes and features)."""
    df = docs.withColumn("__pii_text", F.coalesce(F.col(text_col), F.lit("")))
    for kind in KINDS:
        df = _matched(df, "__pii_text", f"__pii_{kind}", BASE[kind], NEEDS[kind])
        df = df.withColumn(f"__pii_{kind}", F.expr(f"filter(__pii_{kind}, x -> {_valid[kind]})"))
    df = _matched(df, "__pii_text", "__pii_number", NUMBER, None)
    df = _matched(df, "__pii_text", "__pii_spelt", SPELT, None)
    base = F.concat(*(F.expr(f"transform(__pii_{k}, x -> named_struct('kind', '{k}', 'start', x.start, 'end', x.`end`))") for k in KINDS))
    df = df.withColumn("base", base)
    clear = "not exists(base, b -> b.start < x.`end` and x.start < b.`end`)"
    parts = [F.expr(f"transform(__pii_{k}, x -> {_proposal(k, True)})") for k in ("email", "card", "phone")]
    parts += [
        F.expr(f"transform(filter(__pii_number, x -> length({_digits}) between 13 and 19 and luhn_check({_digits}) and {clear}), x -> {_proposal('card', False)})"),
        F.expr(f"transform(filter(__pii_number, x -> length({_digits}) between 7 and 12 and {clear}), x -> {_proposal('phone', False)})"),
        F.expr(f"transform(filter(__pii_spelt, x -> {clear}), x -> {_proposal('email', False)})"),
    ]
    return df.withColumn("proposed", F.concat(*parts)).drop("__pii_text", "__pii_number", "__pii_spelt", *(f"__pii_{k}" for k in KINDS))


@dataclass
class Model:
    """Of each kind: bias, and a weight for each feature."""

    weights: dict[str, list[float]]


FEATURES = [*LABELERS, "few", "many", "groups"]


def _features(votes: np.ndarray, digits: np.ndarray, groups: np.ndarray) -> np.ndarray:
    return np.column_stack([votes, digits < 10, digits > 16, groups / 3.0, np.ones(len(digits))]).astype(float)


def reliabilities(votes: np.ndarray, counts: np.ndarray, known: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Expectation-maximisation on vote patterns (rows) with their counts: the probability that a pattern's spans are
    personal data. Labelers are taken as independent given the truth; ``known`` patterns are true."""
    p = np.where(known, 1.0, np.clip(0.5 + 0.15 * votes.sum(axis=1), 0.05, 0.95))
    for _ in range(rounds):
        log_odds = np.log((counts @ p + 1) / (counts @ (1 - p) + 1)) * np.ones(len(p))
        for j in range(votes.shape[1]):
            yes = np.array([counts @ (p * (votes[:, j] == v)) + 1 for v in (-1, 0, 1)])
            no = np.array([counts @ ((1 - p) * (votes[:, j] == v)) + 1 for v in (-1, 0, 1)])
            log_odds += np.log(yes / yes.sum() / (no / no.sum()))[votes[:, j].astype(int) + 1]
        p = np.where(known, 1.0, 1 / (1 + np.exp(-np.clip(log_odds, -30, 30))))
    return p


def logistic(x: np.ndarray, p: np.ndarray, counts: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weighted logistic regression on probabilities, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        s = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (counts * s * (1 - s))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (counts * (s - p)) + ridge * w)
    return w


def train(found: DataFrame) -> Model:
    """From ``candidates``: what comes to the driver is a count for each pattern of votes and features, of which there
    are some thousands at most whatever the size of the input."""
    keys = ["kind", "base", *LABELERS, "digits", "groups"]
    rows = found.select(F.explode("proposed").alias("x")).select("x.*").groupBy(*keys).agg(F.count("*").alias("n")).collect()
    rows = sorted(rows, key=str)
    weights = {}
    for kind in ("email", "card", "phone"):
        mine = [r for r in rows if r["kind"] == kind]
        if not any(not r["base"] for r in mine):
            weights[kind] = [0.0] * len(FEATURES) + [-30.0]
            continue
        votes = np.array([[r[x] for x in LABELERS] for r in mine], dtype=float)
        n, base = np.array([r["n"] for r in mine], dtype=float), np.array([r["base"] for r in mine])
        p = reliabilities(votes, n, base)
        x = _features(votes, np.array([r["digits"] for r in mine]), np.array([r["groups"] for r in mine]))
        weights[kind] = [float(w) for w in logistic(x, p, n)]
    return Model(weights)


def _score(model: Model, kind: str) -> str:
    names = [*(f"x.{v}" for v in LABELERS), "if(x.digits < 10, 1, 0)", "if(x.digits > 16, 1, 0)", "x.groups / 3.0D", "1"]
    return " + ".join(f"{w!r}D * {n}" for w, n in zip(model.weights[kind], names, strict=True))


def decide(found: DataFrame, model: Model) -> DataFrame:
    """``candidates`` with ``base`` and ``spans`` (base ones and those added) as arrays of (kind, start, end), in the
    order of kinds, then of starts."""
    score = " when ".join(f"'{k}' then {_score(model, k)}" for k in model.weights)
    order = ", ".join(f"'{k}', {i}" for i, k in enumerate(KINDS))
    added = f"transform(filter(proposed, x -> not x.base and (case x.kind when {score} end) >= 0), x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.`end`))"

    def sort(spans: str) -> Column:
        keyed = f"transform({spans}, x -> named_struct('k', map({order})[x.kind], 'start', x.start, 'end', x.`end`, 'kind', x.kind))"
        return F.expr(f"transform(array_sort({keyed}), x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.`end`))")

    return found.withColumn("spans", sort(f"concat(base, {added})")).withColumn("base", sort("base")).drop("proposed")


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``spans``. Texts are scanned once, in one pass without a shuffle; what the scan found
    is kept in the shared folder with the other columns of ``docs``, so select only those that are needed."""
    found = materialize(candidates(docs, text_col), "proposals")
    return decide(found, train(found))


def listed(spans: str) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.start, x.`end`)), ',')")


def masked(text_col: str = "text", spans: str = "spans") -> Column:
    """The text with ``[KIND]`` for each span; of overlapping spans the one that starts first stands for all."""
    by_start = f"array_sort(transform({spans}, x -> named_struct('start', x.start, 'end', x.`end`, 'kind', x.kind)))"
    return F.expr(f"""
      case when {text_col} is null or size({spans}) = 0 then {text_col} else
      aggregate({by_start}, named_struct('out', '', 'at', 0),
        (a, x) -> case when x.start < a.at then named_struct('out', a.out, 'at', greatest(a.at, x.`end`))
          else named_struct('out', concat(a.out, substring({text_col}, a.at + 1, x.start - a.at), '[', upper(x.kind), ']'), 'at', x.`end`) end,
        a -> concat(a.out, substring({text_col}, a.at + 1))) end""")
