"""Personal data by candidate gradient boosting, in DataFrame functions alone.

Strict patterns give base spans (email, ip, card, phone), which always stay.
High-recall generators propose further spans of the same kinds, which may overlap:
addresses written with "at" and "dot", dotted numbers of any length, digit groups
with any separators, local phone numbers. Each candidate has format features
(digits, separators, check digit, top-level domain) and context features (words and
signs before it, its neighbours). Features are small whole numbers, so all
candidates of a table fall into a bounded number of feature cells (product of
the levels). Cells with their positive and negative counts are all the training
sees: boosted trees of depth two are fitted to every candidate of the input, not
to a sample. A candidate is positive if a strict pattern of its kind accepts it, a
weak label. Check digit and number range are features, so that a number that
fails them needs strong evidence of other kinds.

Thresholds are calibrated per kind on texts held out of the fitting: the lowest
margin whose precision among held out candidates is at least ``PRECISION``. A
kind without such a margin adds nothing. The fitted trees become one column
expression, so scoring is a projection; no text leaves the JVM or is shuffled.

Rows: null and empty texts have no spans. Repeated rows and null ids are
treated like any other row; other columns are ignored.
"""
from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridledger.functions.plan import compute_once

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 20
RATE = 0.3
PRECISION = 0.95
HELD_OUT = 5
#: Code points before a candidate that count as its context.
CONTEXT = 24

# Strict patterns. A start inside a run cannot match where its first
# place did not, so a look-behind keeps long runs linear; \G lets a match follow another.
# Repeated groups, which the matcher works off recursively, are runs of one class after a
# replacement that keeps lengths: \x01 a separator between digits, \x03 a dot inside a name.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+\x03-]))[A-Za-z0-9._%+\x03-]++@[A-Za-z0-9-]++\x03[A-Za-z0-9\x03-]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
CARD = r"[0-9][0-9\x01]*+"
OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

# High-recall generators.
SPANS = "array<struct<s: int, e: int, m: string>>"
LOOSE_EMAIL = (r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:@|\(at\)|\[at\]|\x20at\x20) ?"
               r"[A-Za-z0-9-]{1,63}+(?: ?(?:\.|\(dot\)|\[dot\]|\x20dot\x20) ?[A-Za-z0-9-]{1,63}+){1,8}")
LOOSE_IP = r"(?<![0-9.])[0-9]{1,3}+(?:[.:][0-9]{1,3}+){3,7}(?![0-9])"
LOOSE_CARD = r"(?<![0-9])[0-9]{4}[\x20._/-]?[0-9]{4,6}[\x20._/-]?[0-9]{4,5}[\x20._/-]?[0-9]{1,7}(?![0-9])"
LOOSE_PHONE = r"(?<![0-9A-Za-z.])(?:\+|00)?[0-9]{0,3}[\x20.-]{0,2}\(?[0-9]{2,4}\)?[\x20.-]{1,2}[0-9]{3,4}(?:[\x20.-][0-9]{2,4}){0,3}(?![0-9A-Za-z])"


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def found(text: Column, pattern: str) -> Column:
    """Array of (s, e, m) of all matches, start and end in code points.

    The pieces between matches tell the starts. Ends are summed up in chunks of 64 matches, so
    that copying the growing arrays stays cheap with very many matches.
    """
    none = F.array().cast(SPANS)

    def pairs(body: Column) -> Column:
        return F.zip_with(F.split(body, pattern, -1), F.regexp_extract_all(body, F.lit(pattern), F.lit(0)), lambda p, m: F.struct(
            F.length(p).alias("gap"), F.coalesce(F.length(m), F.lit(0)).alias("len"), m.alias("m")))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("s"), (start + x["len"]).alias("e"), x["m"].alias("m"))
        return F.struct((start + x["len"]).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def spans(all_pairs: Column) -> Column:
        def chunk(acc: Column, number: Column) -> Column:
            part = F.aggregate(F.slice(all_pairs, number * 64 + 1, F.lit(64)), F.struct(acc["at"].alias("at"), none.alias("out")), add)
            return _bound(part, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["parts"], F.array(x["out"])).alias("parts")))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("parts"))
        chunks = F.sequence(F.lit(0), F.floor((F.size(all_pairs) - 1) / 64).cast("int"))
        whole = F.aggregate(chunks, zero, chunk, lambda acc: F.flatten(acc["parts"]))
        return F.when(F.size(all_pairs) > 1, F.filter(whole, lambda x: x["m"].isNotNull())).otherwise(none)
    return _bound(text, lambda body: _bound(pairs(body), spans))


def joined(text: Column) -> Column:
    """The text with every single separator between two digits turned into \\x01; its length stays."""
    return F.regexp_replace(F.translate(text, "\x01", "\x02"), r"(?<=[0-9])[\x20-](?=[0-9])", "\x01")


def dotted(text: Column) -> Column:
    """The text with every dot between two signs of a host name turned into \\x03; its length stays."""
    return F.regexp_replace(F.translate(text, "\x03", "\x02"), r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", "\x03")


def digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Check digit test of a string of digits."""
    return F.coalesce(F.call_function("luhn_check", number), F.lit(False))


def _base(text: Column) -> Column:
    """(kind, s, e) of all base spans. Each pattern runs only where its first sign occurs."""
    none = F.array().cast(SPANS)

    def where(test: Column, spans: Column) -> Column:
        return F.when(test, spans).otherwise(none)

    def tag(number: int, spans: Column, keep) -> Column:
        good = F.filter(spans, keep) if keep else spans
        return F.transform(good, lambda x: F.struct(F.lit(number).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    email = where(F.contains(text, F.lit("@")), found(dotted(text), EMAIL))
    ip = where(text.rlike(r"[0-9]\.[0-9]++\.[0-9]"), found(text, IP))
    card = where(text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), found(joined(text), CARD))
    phone = where(F.contains(text, F.lit("+")), found(text, PHONE))
    count = lambda x: F.length(digits(x["m"]))
    return F.concat(
        tag(0, email, None),
        tag(1, ip, lambda x: x["m"].rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")),
        tag(2, card, lambda x: count(x).between(16, 19) & luhn(digits(x["m"]))),
        tag(3, phone, lambda x: count(x).between(8, 15)))


def _candidates(text: Column) -> Column:
    """(kind, s, e, m) proposed by the generators; spans may overlap."""
    none = F.array().cast("array<struct<kind: int, s: int, e: int, m: string>>")

    def tag(number: int, test: str, pattern: str) -> Column:
        spans = F.transform(found(text, pattern), lambda x: F.struct(
            F.lit(number).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m")))
        return F.when(text.rlike(test), spans).otherwise(none)
    return F.concat(
        tag(0, r"@|(?i)[(\[ ]at[)\] ]", LOOSE_EMAIL), tag(1, r"[0-9][.:][0-9]++[.:][0-9]", LOOSE_IP),
        tag(2, r"[0-9]{4}[\x20._/-]?[0-9]{4}", LOOSE_CARD), tag(3, r"[0-9]{2}\)?[\x20.-]{1,2}[0-9]{3}", LOOSE_PHONE))


def _level(value: Column, *bounds: int) -> Column:
    """Number of bounds that a value reaches."""
    out = F.lit(0)
    for bound in bounds:
        out = out + F.coalesce((value >= bound).cast("int"), F.lit(0))
    return out


#: Feature levels by position, see ``_features``; their product bounds the cells of one kind at 27,648.
LEVELS = (4, 4, 3, 3, 4, 4, 2, 3, 2)


def _features(text: Column, x: Column) -> Column:
    """Format and context of a candidate as an array of small numbers."""
    span, number = x["m"], digits(x["m"])
    before = F.lower(F.substring(text, F.greatest(x["s"] - CONTEXT + 1, F.lit(1)), F.least(F.lit(CONTEXT), x["s"])))
    after = F.substring(text, x["e"] + 1, F.lit(1))
    groups = F.length(F.regexp_replace(span, "[^0-9A-Za-z]+", "\x01")) - F.length(F.regexp_replace(span, "[^0-9A-Za-z]+", ""))
    edge = F.when(before == "", 0).when(before.rlike(r"[\s(\[<\"':;,]$"), 1).otherwise(2)
    end = F.when(after == "", 0).when(after.rlike(r"[\s)\]>\"':;,.!?]"), 1).otherwise(2)
    mark = F.when(F.contains(span, F.lit("@")), 3).when(span.startswith("+"), 2).when(F.contains(span, F.lit("(")), 1).otherwise(0)
    cue = F.when(before.rlike(r"mail|contact|write to"), 1).when(
        before.rlike(r"tel|phone|call|fax|mobile|\bip\b|host|addr|server"), 2).when(
        before.rlike(r"card|visa|account|iban|konto"), 3).otherwise(0)
    against = before.rlike(r"(?:version|order|isbn|issn|no|nr|id|page|section|ref)[.:# ]*$").cast("int")
    top = F.when(span.rlike(r"(?i)\.(?:com|org|net|edu|gov|info|io|co|de|fr|es|uk|eu)$"), 2).when(span.rlike("[A-Za-z]"), 1).otherwise(0)
    valid = F.when(x["kind"] == 1, span.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")).when(
        x["kind"] == 2, F.length(number).between(16, 19) & luhn(number)).when(
        x["kind"] == 3, F.length(number).between(8, 15)).otherwise(F.lit(True)).cast("int")
    return F.array(_level(F.length(number), 7, 10, 16), _level(groups, 1, 3, 4), edge, end, mark, cue, against, top, valid)


@dataclass
class Trees:
    """Boosted trees of one kind: (feature, cut, left leaf or tree, right leaf or tree), a prior and a threshold."""

    prior: float = 0.0
    trees: list[tuple] = field(default_factory=list)
    threshold: float | None = None

    def margin(self, features: tuple[int, ...]) -> float:
        return self.prior + sum(_leaf(tree, features) for tree in self.trees)

    def column(self, features: Column) -> Column:
        def build(tree) -> Column:
            if isinstance(tree, float):
                return F.lit(tree)
            at, cut, left, right = tree
            return F.when(F.get(features, F.lit(at)) < cut, build(left)).otherwise(build(right))
        out = F.lit(self.prior)
        for tree in self.trees:
            out = out + build(tree)
        return out


def _leaf(tree, features) -> float:
    while not isinstance(tree, float):
        at, cut, left, right = tree
        tree = left if features[at] < cut else right
    return tree


def boost(cells: dict[tuple[int, ...], tuple[int, int]], rounds: int = ROUNDS, rate: float = RATE, depth: int = 2) -> Trees:
    """Newton boosting of the log loss on feature cells with (negative, positive) counts."""
    negative, positive = (sum(c[i] for c in cells.values()) for i in (0, 1))
    model = Trees(math.log((positive + 1) / (negative + 1)))
    margins = dict.fromkeys(cells, model.prior)

    def grow(part: list[tuple], stats: dict, left_depth: int):
        g, h = (sum(stats[c][i] for c in part) for i in (0, 1))
        value = float(-rate * g / (h + 1))
        if not left_depth:
            return value
        best = (1e-6, None)
        for at, levels in enumerate(LEVELS):
            for cut in range(1, levels):
                low = [c for c in part if c[at] < cut]
                if 0 < len(low) < len(part):
                    gl, hl = (sum(stats[c][i] for c in low) for i in (0, 1))
                    gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                    if gain > best[0]:
                        best = (gain, (at, cut))
        if best[1] is None:
            return value
        at, cut = best[1]
        return (at, cut, grow([c for c in part if c[at] < cut], stats, left_depth - 1),
                grow([c for c in part if c[at] >= cut], stats, left_depth - 1))

    for _ in range(rounds if positive and negative else 0):
        stats = {}
        for cell, (no, yes) in cells.items():
            p = 1 / (1 + math.exp(-margins[cell]))
            stats[cell] = ((no + yes) * p - yes, (no + yes) * p * (1 - p))
        tree = grow(list(cells), stats, depth)
        model.trees.append(tree)
        for cell in cells:
            margins[cell] += _leaf(tree, cell)
    return model


def calibrate(model: Trees, cells: dict[tuple[int, ...], tuple[int, int]], precision: float = PRECISION) -> None:
    """Lowest margin above which held out candidates have the precision; None if there is no such margin."""
    by = sorted(((model.margin(cell), no, yes) for cell, (no, yes) in cells.items()), reverse=True)
    no = yes = 0
    model.threshold = None
    for at, (margin, n, y) in enumerate(by):
        no, yes = no + n, yes + y
        if (at + 1 == len(by) or by[at + 1][0] < margin) and yes and yes >= precision * (no + yes):
            model.threshold = margin


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id"), text.alias("text"), F.pmod(F.xxhash64("text"), F.lit(HELD_OUT)).alias("fold"))
    return compute_once(slim, {"base": _base(F.col("text")), "loose": _candidates(F.col("text"))})


def train(docs: DataFrame) -> dict[int, Trees]:
    """Trees of every kind from the candidates of all rows; the driver sees feature cells alone."""
    each = _rows(docs).select("fold", "text", "base", F.explode("loose").alias("x"))
    accepted = F.exists("base", lambda b: (b["kind"] == F.col("x.kind")) & (b["s"] == F.col("x.s")) & (b["e"] == F.col("x.e")))
    cells = (each.select(F.col("x.kind").alias("kind"), (F.col("fold") == 0).alias("held"), accepted.alias("good"),
                         _features(F.col("text"), F.col("x")).alias("cell"))
             .groupBy("kind", "held", "cell").agg(F.count_if(~F.col("good")).alias("no"), F.count_if("good").alias("yes")))
    fit: dict[int, dict] = {k: {} for k in range(len(KINDS))}
    held: dict[int, dict] = {k: {} for k in range(len(KINDS))}
    for r in cells.collect():  # at most 2 * 4 * 27,648 cells
        (held if r.held else fit)[r.kind][tuple(r.cell)] = (r.no, r.yes)
    models = {}
    for kind in range(len(KINDS)):
        models[kind] = boost(fit[kind])
        calibrate(models[kind], held[kind])
    return models


def spans(docs: DataFrame, models: dict[int, Trees] | None = None) -> DataFrame:
    """(doc_id, base, spans) per row: arrays of (kind, s, e), kinds numbered as in ``KINDS``, sorted by kind and start.

    ``spans`` has the base spans and the candidates above their kind's threshold that
    overlap no base span.
    """
    models = train(docs) if models is None else models
    text = F.col("text")

    def chosen(x: Column) -> Column:
        features = _features(text, x)
        good = F.lit(False)
        for kind, model in models.items():
            if model.threshold is not None:
                good = good | ((x["kind"] == kind) & (model.column(features) >= model.threshold))
        return good & ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
    added = F.transform(F.filter("loose", chosen), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    return _rows(docs).select("doc_id", F.array_sort("base").alias("base"), F.array_sort(F.array_union("base", added)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    name = lambda x: F.element_at(F.array(*(F.lit(k) for k in KINDS)), x["kind"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["s"], x["e"])), ",")


def redacted(docs: DataFrame, models: dict[int, Trees] | None = None) -> DataFrame:
    """(doc_id, text): every span replaced by its kind in brackets, overlapping spans as one."""
    models = train(docs) if models is None else models
    found_spans = spans(docs.select(F.struct("doc_id", "text").alias("doc_id"), "text"), models).toDF("row", "base", "spans")
    text = F.coalesce(F.col("row.text"), F.lit(""))
    by_start = F.array_sort(F.transform("spans", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def put(acc: Column, x: Column) -> Column:
        name = F.element_at(F.array(*(F.lit(f"[{k}]") for k in KINDS)), x["kind"] + 1)
        return F.when(x["s"] >= acc["at"], F.struct(
            F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), name).alias("out"), x["e"].alias("at"))).otherwise(
            F.struct(acc["out"].alias("out"), F.greatest(acc["at"], x["e"]).alias("at")))
    whole = F.aggregate(by_start, start, put, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return found_spans.select("row.doc_id", F.when(F.col("row.text").isNotNull(), whole).alias("text"))
