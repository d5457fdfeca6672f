"""Personal data: fixed shapes, and identifiers found by bootstrapped contextual extraction.

The fixed shapes (mail addresses, IPv4 addresses, card and phone numbers) and long hexadecimal
secrets are seeds. The words left of the seeds, whatever their shape, are candidate patterns. A pattern is scored by
the share of its instances that are known, over all documents; instances of patterns of high confidence become
known, which raises other patterns, round by round until no pattern is added. What trusted patterns extract beyond the
seeds (tokens and grouped digits) is reported as kind ``id``. Only DataFrame functions are used.

Every regular expression is linear in the text: repetitions are possessive, and one that begins
with a repeated class starts only where such a run starts (or where the last match ended).
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmura.functions.durable import cut_lineage, release
from murmura.llm.rows import KEY, key_of, text_of

KINDS = ("email", "ip", "card", "phone", "id")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTETS = r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"
#: A run of ASCII letters and digits with a digit in it, of six characters at least.
TOKEN = r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])[A-Za-z0-9]{6,}+"
#: Digits in groups: of at most five with a blank or hyphen between them, or of any length with hyphens.
GROUPED = (r"(?<![A-Za-z0-9])(?<![0-9][\x20-])(?:[0-9]{1,5}+(?![A-Za-z0-9])(?:[\x20-][0-9]{1,5}+(?![A-Za-z0-9]))++(?!-[0-9])"
           r"|[0-9]++(?:-[0-9]++)++(?![A-Za-z0-9]))")
SECRET = r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]{32,}$"
LEFT = 40
_SPAN = "array<struct<start:int,kind:int,end:int,left:string,value:string>>"


def _matches(text: Column, pattern: str, kind: int) -> Column:
    """All matches in order with their places and LEFT characters before: the text between them is what a split leaves."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        before = F.right(F.concat(s["tail"], x["gap"]), F.lit(LEFT))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), before.alias("left"), x["value"].alias("value"))
        tail = F.right(F.concat(before, x["value"]), F.lit(LEFT))
        return F.struct(end.alias("at"), tail.alias("tail"), F.concat(s["out"], F.array(span)).alias("out"))

    zipped = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.array().cast(_SPAN).alias("out"))
    return F.aggregate(zipped, start, step)["out"]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _fixed_spans(text: Column) -> Column:
    """The spans of the fixed shapes, by start and kind."""
    none = F.array().cast(_SPAN)
    has_digit = text.rlike("[0-9]")
    email = F.when(F.contains(text, F.lit("@")), _matches(text, EMAIL, 0)).otherwise(none)
    ip = F.when(has_digit, F.filter(_matches(text, IP, 1), lambda s: s["value"].rlike(OCTETS))).otherwise(none)
    card = F.when(has_digit, F.filter(
        _matches(text, CARD, 2),
        lambda s: F.length(_digits(s["value"])).between(12, 19) & F.call_function("luhn_check", _digits(s["value"])))).otherwise(none)
    phone = F.when(F.contains(text, F.lit("+")), F.filter(
        _matches(text, PHONE, 3), lambda s: F.length(_digits(s["value"])).between(9, 15))).otherwise(none)
    return F.array_sort(F.concat(email, ip, card, phone))


def _pattern(left: Column) -> Column:
    """The last two words before an instance and what touches it, digits made equal; null if none."""
    said = F.regexp_extract(F.regexp_replace(F.lower(left), "[0-9]+", "0"), r"((?:[^\s]+\s+){0,2}[^\s]*)$", 1)
    return F.when(F.trim(said) != "", said)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(KEY, __doc, base spans, their patterns and values, candidates with their pattern and whether a seed covers them)."""
    text = text_of(text_col)
    found = docs.select(
        *key_of(id_col, text_col), F.col(id_col).alias("__doc"), _fixed_spans(text).alias("base"),
        F.when(text.rlike("[0-9]"), F.filter(
            _matches(text, f"{GROUPED}|{TOKEN}", 4), lambda t: F.length(F.regexp_replace(t["value"], r"[\x20-]", "")) >= 6,
        )).otherwise(F.array().cast(_SPAN)).alias("tokens"))
    token = F.transform("tokens", lambda t: F.struct(
        t["start"].alias("start"), t["end"].alias("end"), _pattern(t["left"]).alias("pattern"), t["value"].alias("value"),
        F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])).alias("covered"),
        F.exists("base", lambda b: b["start"] == t["start"]).alias("seeded"), t["value"].rlike(SECRET).alias("secret")))
    seeds = F.transform("base", lambda b: F.struct(_pattern(b["left"]).alias("pattern"), b["value"].alias("value")))
    plain = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end")))
    return found.select(*KEY, "__doc", plain.alias("base"), seeds.alias("seeds"), token.alias("tokens"))


def trusted_patterns(tokens: DataFrame, rounds: int | None, confidence: float, least: int) -> DataFrame:
    """(pattern) of the pattern-instance graph ``tokens`` (pattern, value, known) after ``rounds``, or when none is added."""
    edges = cut_lineage(tokens.groupBy("pattern", "value").agg(F.max("known").alias("known")))
    good, held = None, 0
    for done in itertools.count(1):
        scored = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.count_if("known").alias("k"))
        good = cut_lineage(scored.where((F.col("k") >= least) & (F.col("k") >= confidence * F.col("n"))).select("pattern"))
        # What is known only grows, so the trusted patterns do.
        before, held = held, good.count()
        if held == before or done == rounds:
            return good
        trusted = edges.join(good, "pattern", "left_semi").groupBy("value").agg(F.lit(True).alias("found"))
        spent, edges = edges, cut_lineage(edges.join(trusted, "value", "left").select(
            "pattern", "value", (F.col("known") | F.coalesce("found", F.lit(False))).alias("known")))
        release(spent, good)


def find_spans(
    docs: DataFrame, rounds: int | None = None, confidence: float = 0.8, least: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(KEY, id_col, base, spans), a row per row of ``docs``; spans are (start, kind, end) in code points.

    ``base`` holds the fixed shapes, ``spans`` these and the discovered identifiers, which never overlap a base
    span. A pattern is trusted with ``least`` distinct known instances that are a share of
    ``confidence`` of its distinct instances; every base span is a known one. ``rounds`` bounds the rounds where it is given. A null text is empty; equal rows get equal spans; other columns are not
    looked at; an empty table gives no rows.
    """
    scanned = cut_lineage(_scanned(docs, id_col, text_col))
    tokens = scanned.select(*KEY, F.explode("tokens").alias("t")).select(*KEY, "t.*").where("pattern IS NOT NULL")
    seeds = scanned.select(F.explode("seeds").alias("s")).select("s.*", F.lit(True).alias("known")).where("pattern IS NOT NULL")
    # A candidate that begins with a base span is that instance already.
    others = tokens.where(~F.col("seeded")).select("pattern", "value", (F.col("covered") | F.col("secret")).alias("known"))
    good = trusted_patterns(seeds.unionByName(others), rounds, confidence, least)
    more = tokens.where(~F.col("covered")).join(good, "pattern", "left_semi").groupBy(*KEY).agg(
        F.collect_set(F.struct("start", F.lit(4).alias("kind"), "end")).alias("more"))
    all_spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more")))
    return scanned.drop("tokens", "seeds").join(more, list(KEY), "left").select(
        *KEY, F.col("__doc").alias(id_col), "base", all_spans.alias("spans"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, n_id, base_sha256, spans) of ``find_spans``."""
    found = find_spans(docs, id_col=id_col, text_col=text_col, **options)

    def count(k: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")

    return found.select(
        id_col, *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; of overlapping spans the first names all."""
    spans = find_spans(docs, id_col=id_col, text_col=text_col, **options).groupBy(*KEY).agg(F.first("spans").alias("__spans"))
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    text = F.col(text_col)

    def step(s: Column, x: Column) -> Column:
        fresh = x["start"] >= s["at"]
        gap = F.substring(text, s["at"] + 1, x["start"] - s["at"])
        return F.struct(
            F.greatest(s["at"], x["end"]).alias("at"),
            F.when(fresh, F.concat(s["out"], F.array(gap, F.get(names, x["kind"])))).otherwise(s["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    state = F.aggregate("__spans", start, step)
    whole = F.concat(F.array_join(state["out"], ""), F.substring(text, state["at"] + 1, F.length(text)))
    keyed = docs.select(*[docs[c] for c in docs.columns], *key_of(id_col, text_col))
    joined = keyed.join(spans.where(F.size("__spans") > 0), list(KEY), "left").withColumn(
        text_col, F.when(F.col("__spans").isNull(), text).otherwise(whole))
    return joined.select(*docs.columns)
