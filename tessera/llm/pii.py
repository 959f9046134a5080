"""Personal data and secrets by weak supervision.

Candidate spans come from patterns: the strict ones, whose spans always stand, and wider ones. Labelers
vote on each, and may disagree: the strict pattern, a check (sums, ranges, mixture of characters), the layout, gazetteers
(card and phone prefixes, mail domains, address ranges, key prefixes) and the words before the span. Expectation-maximisation
over the counts of vote patterns, a few thousand rows at most, estimates each labeler's reliability without labels; its
posteriors train the span classifier, a logistic one over votes and length, which decides on the wider candidates. Text is
handled by DataFrame functions only; what is fitted are a few dozen numbers.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, cut, read_table

KINDS = ("email", "ip", "card", "phone", "secret")
#: Kinds with base spans.
BASE_KINDS = KINDS[:4]
#: The strict patterns. Possessive, and begun only where a run or a find begins: the same finds in linear time.
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a strict find.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Wider patterns: written-out addresses, IPv6, national phone numbers, runs that may be keys. Wider card candidates are the strict pattern's failed finds.
WIDE = {
    "email": r"[A-Za-z0-9._%+-]++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9+(.-])(?<![0-9]\x20)(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])",
    "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,128}+(?![A-Za-z0-9+/_-])",
}
#: Fixed gazetteers: first digits of card networks, mail domains' last labels, common country codes, reserved first parts of addresses.
CARD_PREFIXES = r"^(4|5[1-5]|2[2-7]|34|37|30|36|38|6011|65|35)"
MAIL_ENDS = r"(?i)\.(com|org|net|edu|gov|io|info|de|fr|es|uk|eu)$"
PHONE_PREFIXES = r"^\+?(1|33|34|44|49|39|31|32|41|43|45|46|47|48|351|52|55|61|81|86|91)(?![0-9])|^\([2-9]"
RESERVED = r"^(0|22[4-9]|2[3-5][0-9])\."
KEY_PREFIXES = r"^(AKIA|ASIA|gh[opsu]_|xox[abp]-|sk-|eyJ)"
#: Fixed layouts: cards in one run or in fours, keys as hexadecimal digests or access keys, phone numbers in groups, addresses of four short parts.
LAYOUTS = {
    "email": r"^[A-Za-z0-9].*[A-Za-z]$", "ip": r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$|:", "card": r"^([0-9]{16}|[0-9]{4}([\x20-][0-9]{4}){3}|3[47][0-9]{13})$",
    "phone": r"[\x20().-]", "secret": r"^([0-9a-f]{18}|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[A-Z0-9]{20})$",
}
#: Words that announce a kind, in the four languages.
CONTEXT = {
    "email": r"(?i)(e-?mail|mail|correo|courriel|contact|write to)\W*$",
    "ip": r"(?i)\b(ip|host|server|address|addr|client)\W*$",
    "card": r"(?i)(card|visa|mastercard|credit|karte|tarjeta|carte)\W*(no|number)?\W*$",
    "phone": r"(?i)(phone|tel|call|fax|mobile|cell|telefon|tel.fono|appel)\w*\W*$",
    "secret": r"(?i)(token|secret|passw(or)?d|passwort|pwd|api.?key|access.?key|credential|auth\w*)\W{0,6}$",
}
#: A wider candidate becomes a span if the classifier is this sure.
SURE = 0.9
VOTES = ("v_pattern", "v_check", "v_layout", "v_gazetteer", "v_context")
FIT_ROUNDS = 50
#: What is assumed of a labeler before it is seen, as counts of votes for, none and against, on true spans; on others reversed.
PRIOR = {1: 6.0, 0: 4.0, -1: 2.0}
#: Finds whose places are summed up together; bounds the work on texts with very many.
CHUNK = 64


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if a text of digits passes the Luhn check."""
    n = F.length(digits)
    value = lambda i: F.try_to_number(F.substring(digits, i, F.lit(1)), F.lit("9")).cast("int")
    doubled = lambda i: F.when((n - i) % 2 == 1, F.when(value(i) * 2 > 9, value(i) * 2 - 9).otherwise(value(i) * 2)).otherwise(value(i))
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + doubled(i)) % 10 == 0


def passes(kind: str, m: Column) -> Column:
    """The strict checks on a find: address parts at most 255, card length and Luhn, number of phone digits."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, r"^0+(?=.)", "").rlike(r"^([0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    d = _digits(m)
    if kind == "card":
        return F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False))
    return F.length(d).between(8, 15)


def _finds(text: Column, pattern: str, possible: Column) -> Column:
    """Array of (start, end, found, before, after) of a pattern's finds, in code points; before and after: the text's characters next to the find.

    split() with the same pattern gives what lies between the finds; lengths add up to places, in chunks and then over them.
    """
    kind = "array<struct<start:bigint,end:bigint,found:string,before:string,after:string>>"
    zero, none = F.lit(0).cast("long"), F.array().cast(kind)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["found"])
        one = F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), x["found"].alias("found"), F.right(x["gap"], F.lit(24)).alias("before"), F.left(x["next"], F.lit(1)).alias("after"))
        return F.struct(end.cast("long").alias("at"), F.concat(acc["out"], F.array(one)).cast(kind).alias("out"))

    def moved(x: Column, base: Column) -> Column:
        return F.transform(x["out"], lambda f: F.struct((f["start"] + base).alias("start"), (f["end"] + base).alias("end"), f["found"].alias("found"), f["before"].alias("before"), f["after"].alias("after")))

    def paired(found: Column, gaps: Column) -> Column:
        between = F.zip_with(F.slice(gaps, 1, F.size(found)), F.slice(gaps, 2, F.size(found)), lambda a, b: F.struct(a.alias("gap"), b.alias("next")))
        return F.zip_with(found, between, lambda f, g: F.struct(f.alias("found"), g["gap"].alias("gap"), g["next"].alias("next")))

    def placed(pairs: Column) -> Column:
        n = F.greatest(F.lit(1), F.ceil(F.size(pairs) / CHUNK).cast("int"))
        chunks = F.transform(F.sequence(F.lit(0), n - 1), lambda c: F.aggregate(F.slice(pairs, c * CHUNK + 1, F.lit(CHUNK)), F.struct(zero.alias("at"), none.alias("out")), step))
        grow = lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["bases"], F.array(acc["at"])).alias("bases"))
        based = lambda xs: F.zip_with(xs, F.aggregate(xs, F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("bases")), grow)["bases"], moved)
        return F.flatten(_once(chunks, based))

    # Each pattern goes over a text once; what lies between finds is only made where there are any.
    every = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    with_gaps = lambda found: _once(F.split(text, pattern, -1), lambda gaps: _once(paired(found, gaps), placed))
    return F.when(possible, _once(every, lambda found: F.when(F.size(found) > 0, with_gaps(found)).otherwise(none))).otherwise(none)


def _once(value: Column, use) -> Column:
    """use(value), with value made once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _voted(kind: str, finds: Column, strict: bool) -> Column:
    """The finds with votes (1 for, -1 against, 0 none), their length and whether they are base spans."""

    def vote(x: Column) -> Column:
        m, digits = x["found"], _digits(x["found"])
        ok = passes(kind, m) if strict else F.lit(False)
        listed = {"card": digits.rlike(CARD_PREFIXES), "email": m.rlike(MAIL_ENDS), "phone": m.rlike(PHONE_PREFIXES), "ip": ~m.rlike(RESERVED), "secret": m.rlike(KEY_PREFIXES)}[kind]
        letters = F.regexp_replace(m, "[^A-Za-z]", "")
        mixed = ((F.length(digits) >= 1) | listed) & (F.length(letters) >= 2) & (F.size(F.array_distinct(F.split(m, ""))) >= 7)
        check = {"email": ~m.rlike(r"\.\.|^[.]|[.]@"), "ip": passes("ip", m) if strict else F.lit(True), "card": luhn(digits), "phone": F.length(digits).between(8, 15), "secret": mixed}[kind]
        alone = ~x["after"].rlike("[A-Za-z0-9]") & ~x["before"].rlike("[A-Za-z0-9]$")
        known = ok if kind in BASE_KINDS else m.rlike(KEY_PREFIXES) | x["before"].rlike(r"[=:]\s?[\x22\x27]?$")
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), ok.alias("base"),
            F.when(known, 1).otherwise(-1).alias("v_pattern"), F.when(check, 1).otherwise(-1).alias("v_check"),
            F.when(alone & m.rlike(LAYOUTS[kind]), 1).otherwise(-1).alias("v_layout"),
            F.when(listed, 1).otherwise(0 if kind == "secret" else -1).alias("v_gazetteer"),
            F.when(x["before"].rlike(CONTEXT[kind]), 1).otherwise(0).alias("v_context"), F.least(F.length(m), F.lit(63)).alias("length"),
        )

    return F.transform(finds, vote)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): for each row the array of its voted candidates. A short run of digits is no card candidate; a run without letters, or without digits and a known prefix, no key."""
    # The digit test stands in a projection of its own, so that it is made once for a text.
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.col("text").rlike("[0-9]").alias("digit"))
    text, digit, parts = F.col("text"), F.col("digit"), []
    has = lambda *words: functools.reduce(Column.__or__, [F.contains(text, F.lit(w)) for w in words])
    for kind in KINDS:
        if kind in STRICT:
            possible = digit if NEEDS[kind] is None else has(NEEDS[kind]) if kind == "email" else digit & has(NEEDS[kind])
            finds = _finds(text, STRICT[kind], possible)
            if kind == "card":
                finds = F.filter(finds, lambda x: F.length(_digits(x["found"])).between(13, 19))
            parts.append(_voted(kind, finds, True))
        if kind in WIDE:
            hint = {"email": has("at)", "at]"), "ip": digit & has(":"), "phone": digit & has("-", "."), "secret": digit | has("AKIA", "ASIA")}[kind]
            finds = _finds(text, WIDE[kind], hint)
            if kind == "secret":
                finds = F.filter(finds, lambda x: (x["found"].rlike("[0-9]") | x["found"].rlike(KEY_PREFIXES)) & x["found"].rlike("[A-Za-z]"))
            parts.append(_voted(kind, finds, False))
    return rows.select("doc_id", F.concat(*parts).alias("spans"))


def fit_votes(counts: list[tuple[int, tuple[int, ...], int, int]]) -> dict[int, tuple[float, list[float]]]:
    """For each kind (bias, weights) of the span classifier, from (kind, votes, length, count); the last weight is that of the length.

    Expectation-maximisation of a two-class model in which labelers vote independently: for each class and labeler the
    share of each vote, from a start that believes the majority and, weakly, that each labeler is right. The logistic
    classifier is then fitted to the posteriors, weighted by count, by Newton's method with a small ridge.
    """
    out = {}
    for kind in sorted({c[0] for c in counts}):
        rows = [(v, size, n) for k, v, size, n in sorted(counts) if k == kind]
        post = [1 / (1 + math.exp(-float(sum(v)))) for v, _, _ in rows]
        for _ in range(FIT_ROUNDS):
            prior = (sum(p * n for p, (_, _, n) in zip(post, rows, strict=True)) + 1) / (sum(n for _, _, n in rows) + 2)
            share: list[dict[int, tuple[float, float]]] = []
            for j in range(len(rows[0][0])):
                yes, no = dict(PRIOR), {x: PRIOR[-x] for x in PRIOR}
                for p, (v, _, n) in zip(post, rows, strict=True):
                    yes[v[j]] += p * n
                    no[v[j]] += (1 - p) * n
                ty, tn = sum(yes.values()), sum(no.values())
                share.append({x: (yes[x] / ty, no[x] / tn) for x in yes})
            post = []
            for v, _, _ in rows:
                odds = math.log(prior / (1 - prior)) + sum(math.log(share[j][x][0] / share[j][x][1]) for j, x in enumerate(v))
                post.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        w = _logistic([[1.0, *map(float, v), size / 16] for v, size, _ in rows], post, [float(n) for _, _, n in rows])
        out[kind] = (w[0], w[1:])
    return out


def _logistic(x: list[list[float]], y: list[float], n: list[float], rounds: int = 25, ridge: float = 1.0) -> list[float]:
    size = len(x[0])
    w = [0.0] * size
    for _ in range(rounds):
        a = [[ridge * (i == j) for j in range(size)] + [-ridge * w[i]] for i in range(size)]
        for row, target, count in zip(x, y, n, strict=True):
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(b * c for b, c in zip(w, row, strict=True))))))
            for i in range(size):
                for j in range(size):
                    a[i][j] += count * p * (1 - p) * row[i] * row[j]
                a[i][size] += count * (target - p) * row[i]
        for i in range(size):  # elimination; the ridge keeps pivots above zero
            for k in range(i + 1, size):
                f = a[k][i] / a[i][i]
                a[k] = [u - f * v for u, v in zip(a[k], a[i], strict=True)]
        step = [0.0] * size
        for i in range(size - 1, -1, -1):
            step[i] = (a[i][size] - sum(a[i][j] * step[j] for j in range(i + 1, size))) / a[i][i]
        w = [u + v for u, v in zip(w, step, strict=True)]
    return w


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans, all_spans): one row for each row of docs.

    Counts by kind and the digest are of the base spans; spans lists them and the n_added ones that the classifier adds, `secret` ones
    last, as kind:start:end by kind and start; all_spans has the n_spans of them as an array. An added span never overlaps a base
    span. A null text counts as empty. Null ids and repeated rows pass through; an empty table gives no rows; other
    columns are not read.
    """
    found = cut(candidates(docs, id_col, text_col), "candidates")
    size = (F.col("s.length") / 8).cast("int") * 8
    votes = found.select(F.explode("spans").alias("s")).groupBy(F.col("s.kind").alias("kind"), *[F.col(f"s.{v}").alias(v) for v in VOTES], size.alias("size")).count()
    # 5 kinds, at most 3 ** 5 patterns each, 8 lengths.
    model = fit_votes([(r["kind"], tuple(r[v] for v in VOTES), r["size"], r["count"]) for r in votes.collect()])

    def sure(s: Column) -> Column:
        out = F.lit(False)
        for kind, (bias, weights) in model.items():
            z = F.lit(bias) + (s["length"] / 8).cast("int") * F.lit(weights[-1] / 2)
            for v, w in zip(VOTES, weights, strict=False):
                z = z + s[v] * w
            out = F.when(s["kind"] == kind, z >= math.log(SURE / (1 - SURE))).otherwise(out)
        return out

    base = F.filter("spans", lambda s: s["base"])
    meets = lambda s: F.exists(F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    added = F.filter("spans", lambda s: ~s["base"] & sure(s) & ~meets(s))
    narrow = lambda xs: F.array_sort(F.transform(xs, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    name = F.array(*[F.lit(k) for k in KINDS])
    written = lambda xs: F.concat_ws(",", F.transform(xs, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))
    of_kind = lambda i: lambda s: s["kind"] == i
    counts = [F.size(F.filter("base", of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)]
    df = found.withColumn("base", base).withColumn("added", added).withColumn("every", narrow(F.concat("base", "added")))
    more = [F.size("added").cast("long").alias("n_added"), F.size("every").cast("long").alias("n_spans")]
    return df.select("doc_id", *counts, F.sha2(written(narrow(F.col("base"))).cast("binary"), 256).alias("base_sha256"), written(F.col("every")).alias("spans"), *more, F.col("every").alias("all_spans"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(read_table(spark, sf_dir, "documents")).drop("all_spans")
