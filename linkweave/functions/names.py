"""Names: clean tokens, core, legal forms, alternate names, skeletons. All are columns of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkweave.functions import vocabulary as v


def literal_map(words: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in words.items() for x in kv])


def lookup(words: dict[str, str], token: Column) -> Column:
    """The token's canonical form, or itself."""
    return F.coalesce(F.try_element_at(literal_map(words), token), token)


def collapse_doubles(c: Column) -> Column:
    return F.regexp_replace(c, r"([a-z])\1+", "$1")


def words(c: Column) -> Column:
    """Runs of letters and digits, doubled letters collapsed."""
    return F.filter(F.split(collapse_doubles(F.regexp_replace(c, "[^a-z0-9]+", " ")), " "), lambda t: t != "")


def nonlatin(c: Column) -> Column:
    """Whether a character is beyond Latin Extended-B."""
    return c.rlike("[^\\x{0}-\\x{24F}]")


def plain_tokens(s: Column) -> Column:
    """Tokens of a lower-case name with legal forms in canonical spelling, except those that need one before them."""
    s = F.regexp_replace(s, v.DOMAIN, " $1 ")
    for sign in ("&", "+"):
        s = F.replace(s, F.lit(sign), F.lit(" and "))
    for sign in ("'", "`"):
        s = F.replace(s, F.lit(sign), F.lit(""))
    s = F.regexp_replace(s, v.DOTTED, "$1")
    return F.transform(words(s), lambda t: lookup(v.LEGAL, t))


def contextual_legal(tokens: Column) -> Column:
    """Ambiguous abbreviations become legal forms right after a legal form, itself perhaps just found.

    One pass over the joined words: a match starts at a legal form or where the last one ended.
    """
    line = F.array_join(tokens, " ")
    for short, form in v.LEGAL_AFTER_LEGAL.items():
        line = F.regexp_replace(line, rf"((?:^| )(?:{'|'.join(v.LEGAL_KINDS)})|\G) {short}(?= |$)", f"$1 {form}")
    return F.filter(F.split(line, " "), lambda t: t != "")


def tokens(s: Column) -> Column:
    return contextual_legal(plain_tokens(s))


def core(toks: Column) -> Column:
    """Tokens that are neither legal forms nor stop words; if none is left, those that are no stop words, else all."""
    stop, legal = (F.array(*map(F.lit, x)) for x in (v.NAME_STOP, v.LEGAL_KINDS))
    spoken = F.filter(toks, lambda t: ~F.array_contains(stop, t))
    own = F.filter(spoken, lambda t: ~F.array_contains(legal, t))
    return F.when(F.size(own) > 0, own).when(F.size(spoken) > 0, spoken).otherwise(toks)


def legal_bits(toks: Column) -> Column:
    """The places in LEGAL_KINDS of the legal forms among the tokens, as bits; the tokens are read once."""
    places = F.create_map(*[x for k, kind in enumerate(v.LEGAL_KINDS) for x in (F.lit(kind), F.lit(1 << k).cast("long"))])
    found = F.array_intersect(toks, F.array(*map(F.lit, v.LEGAL_KINDS)))
    return F.aggregate(found, F.lit(0).cast("long"), lambda acc, kind: acc.bitwiseOR(F.try_element_at(places, kind)))


def split_alternate(s: Column) -> tuple[Column, Column]:
    """(name, alternate) around the first marker of a former or trading name; a name that starts with one is the other."""
    pattern = rf"(?s)^(.*?){v.ALTERNATE}(.*)$"
    marked = s.rlike(v.ALTERNATE)
    before, after = F.regexp_extract(s, pattern, 1), F.regexp_extract(s, pattern, 2)
    swap = (F.trim(before) == "") & (F.trim(after) != "")
    name = F.when(marked, F.when(swap, after).otherwise(before)).otherwise(s)
    return name, F.when(marked & ~swap, after).otherwise(F.lit(""))


def with_name_fields(df, latin: str, prefix: str = "name_"):
    """`df` with clean, core, compact, legal and alt of the lower-case Latin name in column `latin`."""
    name, alt = split_alternate(F.regexp_replace(F.col(latin), v.MESSRS, ""))
    out = df.withColumns({"_name": name, "_alt": alt})
    out = out.withColumn("_toks", tokens(F.col("_name"))).withColumn("_core", core(F.col("_toks")))
    out = out.withColumns({
        f"{prefix}clean": F.array_join("_toks", " "),
        f"{prefix}core": F.array_join("_core", " "),
        f"{prefix}compact": F.array_join("_core", ""),
        f"{prefix}legal": legal_bits(F.col("_toks")),
        f"{prefix}alt": F.when(F.trim("_alt") == "", "").otherwise(F.array_join(core(tokens(F.col("_alt"))), " ")),
    })
    return out.drop("_name", "_alt", "_toks", "_core")


def skeleton(c: Column) -> Column:
    """Classes of consonants: sounds that transliterations confuse fall together, vowels go, runs shrink to one."""
    s = F.regexp_replace(c, v.SOFT_C, "s")
    for a, b in v.DIGRAPHS:
        s = F.replace(s, F.lit(a), F.lit(b))
    s = F.translate(F.replace(s, F.lit("c"), F.lit("k")), v.CLASS_FROM + v.CLASS_GONE, v.CLASS_TO)
    return F.regexp_replace(s, r"(.)\1+", "$1")
