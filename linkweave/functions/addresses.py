"""Addresses: segments, regions, canonical words, numbers, postal codes, landmarks.

An address is folded over its comma segments, since a region code that one segment shows can rewrite a later one.
Everything is a column of built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkweave.functions import vocabulary as v
from linkweave.functions.names import collapse_doubles, literal_map, lookup, words

DIGITS = r"^\d+$"
#: Backwards, a name stands before any that it begins with, so the longer one is taken.
REGION_NAME = rf"\b({'|'.join(sorted(v.REGIONS, reverse=True))})\b"


def number(t: Column) -> Column:
    """Without leading zeros, one digit at least."""
    return F.regexp_replace(t, "^0+(?=.)", "")


def region_of(name: Column) -> Column:
    """The code that a whole name or a code stands for, else null."""
    code = F.when(name.isin(*v.REGIONS.values()), name)
    return F.coalesce(F.try_element_at(literal_map(v.REGIONS), name), F.try_element_at(literal_map(v.REGION_CODE_OTHER), name), code)


def merged(region: Column) -> Column:
    return lookup(v.REGION_MERGED, region)


def cleaned(s: Column) -> Column:
    """Without boxes, placeholders, number prefixes, ordinal endings and dotted abbreviations."""
    s = F.regexp_replace(F.regexp_replace(s, v.JUNK, " "), v.ORDINAL, "$1")
    return F.regexp_replace(s, v.DOTTED, "$1")


def bound(value: Column, body) -> Column:
    """body(value), with the value computed once however often body speaks of it."""
    return F.transform(F.array(value), body)[0]


def segments(s: Column) -> Column:
    """Per segment: landmark, words, and whether it is the last that is not blank."""

    def last_filled(parts: Column) -> Column:
        filled = F.filter(F.transform(parts, lambda p, i: F.when(F.trim(p) != "", i)), lambda i: i.isNotNull())
        return F.struct(parts.alias("parts"), F.coalesce(F.array_max(filled), F.lit(-1)).alias("last"))

    def every(known: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            landmark = F.regexp_extract(p, v.LANDMARK, 0)
            kept = F.regexp_replace(p, v.LANDMARK, "")  # a landmark reaches to the segment's end
            return F.struct(landmark.alias("landmark"), words(kept).alias("words"), (i == known["last"]).alias("last"))

        return F.transform(known["parts"], one)

    return bound(bound(F.split(cleaned(s), "[,;\\n]", -1), last_filled), every)


def described(segs: Column) -> Column:
    """Per segment what the fold needs of it, computed once: canonical words, numbers, and the regions it may show."""

    def one(seg: Column) -> Column:
        ws = seg["words"]
        digits, alpha = F.filter(ws, lambda w: w.rlike(DIGITS)), F.filter(ws, lambda w: ~w.rlike(DIGITS))
        last = F.when(F.size(alpha) >= 2, F.try_element_at(alpha, F.lit(-1))).otherwise("")
        return F.struct(
            ws.alias("words"),
            F.transform(ws, lambda w: F.when(w.rlike(DIGITS), number(w)).otherwise(lookup(v.ADDRESS, w))).alias("canon"),
            F.transform(digits, number).alias("numbers"),
            ((F.size(digits) == 1) & F.coalesce(F.length(F.try_element_at(digits, F.lit(1))).isin(5, 6), F.lit(False))).alias("postal"),
            region_of(F.array_join(alpha, " ")).alias("whole"),
            last.alias("ending"),
            region_of(last).alias("code"),
            seg["last"].alias("last"),
        )

    return F.transform(segs, one)


def _folded(segs: Column) -> Column:
    """toks, strong (regions of segments that are nothing else) and medium (a code that ends one)."""
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("toks"), empty.alias("strong"), F.lit("").alias("medium"))

    def step(acc: Column, seg: Column) -> Column:
        strong = seg["whole"].isNotNull() & ((F.size(seg["numbers"]) == 0) | seg["postal"])
        found = seg["code"].isNotNull() & (F.length(seg["ending"]) <= 3) & (seg["last"] | seg["postal"])
        medium = F.when(found, seg["code"]).otherwise(acc["medium"])
        promoted = (medium != "") & F.coalesce(seg["code"] == medium, F.lit(False))
        plain = F.when(promoted, F.transform(seg["words"], lambda w, i: F.when(w == seg["ending"], seg["code"]).otherwise(F.get(seg["canon"], i)))).otherwise(seg["canon"])
        as_region = F.struct(
            F.concat(acc["toks"], seg["numbers"], F.array(seg["whole"])).alias("toks"),
            F.array_append(acc["strong"], merged(seg["whole"])).alias("strong"),
            acc["medium"].alias("medium"),
        )
        as_words = F.struct(F.concat(acc["toks"], plain).alias("toks"), acc["strong"].alias("strong"), medium.alias("medium"))
        return F.when(F.size(seg["words"]) == 0, acc).when(strong, as_region).otherwise(as_words)

    return F.aggregate(segs, start, step)


def region_names_to_codes(s: Column) -> tuple[Column, Column]:
    """The text with every region name as its code, and the code of the last name (empty if none).

    Names are marked first and replaced after, so a code that is put in is not read again.
    """
    marked = F.split(F.regexp_replace(s, REGION_NAME, "\u0001$1\u0002"), "\u0001")
    codes = literal_map(v.REGIONS)

    def one(p: Column, i: Column) -> Column:
        name = F.split(p, "\u0002")[0]
        rest = F.substring(p, F.length(name) + 2, F.length(p))
        return F.when((i > 0) & p.contains("\u0002"), F.concat(F.try_element_at(codes, name), rest)).otherwise(p)

    names = F.regexp_extract_all(s, F.lit(REGION_NAME), 1)
    weak = F.coalesce(F.try_element_at(codes, F.try_element_at(names, F.lit(-1))), F.lit(""))
    return F.array_join(F.transform(marked, one), ""), weak


def with_address_fields(df, latin: str):
    """`df` with clean, alpha, numbers, postal, landmark and region of the lower-case Latin address in column `latin`."""
    out = df.withColumn("_segs", segments(F.col(latin))).withColumn("_seen", described(F.col("_segs"))).withColumn("_fold", _folded(F.col("_seen")))
    text = F.array_join(F.filter("_fold.toks", lambda t: t != ""), " ")
    out = out.withColumn("_text", text)
    clean, weak = region_names_to_codes(F.col("_text"))
    out = out.withColumns({"addr_clean": clean, "_weak": weak})
    landmarks = F.array_join(F.filter(F.transform("_segs", lambda x: x["landmark"]), lambda x: x != ""), " ")
    strong = F.array_join(F.array_sort(F.array_distinct("_fold.strong")), "|")
    soft = F.when(F.col("_fold.medium") != "", F.col("_fold.medium")).otherwise(F.col("_weak"))
    postal = F.regexp_extract_all("addr_clean", F.lit(v.POSTAL), 1)
    out = out.withColumns({
        "addr_alpha": F.array_join(F.filter(F.split("addr_clean", " "), lambda t: (t != "") & ~t.rlike(DIGITS)), " "),
        "addr_numbers": F.array_join(F.array_distinct(F.regexp_extract_all("addr_clean", F.lit(r"(\d+)"), 1)), " "),
        "postal": F.coalesce(F.try_element_at(postal, F.lit(-1)), F.lit("")),
        "addr_landmark": F.trim(collapse_doubles(F.regexp_replace(landmarks, "[^a-z0-9]+", " "))),
        "region": F.when(F.size("_fold.strong") > 0, strong).otherwise(merged(soft)),
    })
    return out.drop("_segs", "_seen", "_fold", "_text", "_weak")
