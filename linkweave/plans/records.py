"""Queries over records made of documents: names, addresses, regions.

A document is a record: its first line is the name, all other lines are the address. Endings that real sources have
(legal forms, trading names, postal codes, landmarks) are added by doc_id, so that every rule finds work.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from linkweave.functions import addresses, names, translit, vocabulary
from linkweave.operators import metrics, normalize, regions
from linkweave.plans import fixtures as fx
from linkweave.plans import sqltext as q

NAME_ENDS = ["", " Pvt Ltd", " LLC", " & Sons Inc", " Oak Pra Li", " Company", " d/b/a Blue Sky Cafe", " GmbH"]
ADDRESS_ENDS = [", IL 62704", ", Near Oak Ct, Pune, Maharashtra 411001", ", 12 Fl 0, Boston, MA 02134", ", PO BOX 123, 45 Main St 5th", "", ", New York"]


def records(spark, sf):
    """entity_id, source, country, business_name, business_address and region."""
    d = fx.table(spark, sf, "documents")
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("ß"), F.lit("ss"))
    first = F.substring_index(text, "\n", 1)
    rest = F.substring(text, F.length(first) + 2, F.length(text))
    end = lambda ends: F.element_at(F.array(*map(F.lit, ends)), (F.col("doc_id") % len(ends) + 1).cast("int"))
    plain = lambda c: F.replace(c, F.lit("."), F.lit(" "))
    return d.select(
        F.col("doc_id").alias("entity_id"),
        (1 + F.col("doc_id") % 3).alias("source"),
        F.col("lang").alias("country"),
        F.concat(plain(first), end(NAME_ENDS)).alias("business_name"),
        F.concat(plain(rest), end(ADDRESS_ENDS)).alias("business_address"),
        F.when(F.col("n_chars") % 4 == 0, "").otherwise(F.concat(F.lit("r"), F.col("n_chars") % 3)).alias("region"),
    )


def _latin(spark, sf):
    r = records(spark, sf)
    return r.withColumns({"n": translit.latin("business_name"), "a": translit.latin("business_address")})


def collapse_doubles(spark, sf):
    return _latin(spark, sf).select("entity_id", names.collapse_doubles(F.col("n")).alias("name"), F.md5(names.collapse_doubles(F.col("a"))).alias("address_md5"))


def _alt(spark, sf):
    name, alt = names.split_alternate(F.regexp_replace(F.col("n"), vocabulary.MESSRS, ""))
    return _latin(spark, sf).select("entity_id", name.alias("name"), alt.alias("alt"))


def alt_split(spark, sf):
    return _alt(spark, sf)


def name_tokens(spark, sf):
    return _alt(spark, sf).select("entity_id", F.array_join(names.tokens(F.col("name")), " ").alias("name_clean"))


def name_core(spark, sf):
    toks = _alt(spark, sf).withColumn("toks", names.tokens(F.col("name")))
    return toks.select("entity_id", F.array_join(names.core(F.col("toks")), " ").alias("name_core"))


def legal_bits(spark, sf):
    return _alt(spark, sf).select("entity_id", names.legal_bits(names.tokens(F.col("name"))).alias("name_legal"))


def nonlatin_flags(spark, sf):
    return records(spark, sf).select("entity_id", names.nonlatin(F.col("business_name")).alias("name_nonlatin"))


def skeleton(spark, sf):
    """Of every distinct word of the names and addresses."""
    every = F.concat(names.words(F.col("n")), names.words(F.col("a")))
    found = _latin(spark, sf).select(F.explode(every).alias("word")).distinct()
    return found.select("word", names.skeleton(F.col("word")).alias("skeleton"))


def _segments(spark, sf):
    rows = _latin(spark, sf).select("entity_id", F.posexplode(addresses.segments(F.col("a"))).alias("segment", "s"))
    return rows.select("entity_id", F.col("segment").cast("long").alias("segment"), "s.landmark", F.array_join("s.words", " ").alias("words"), F.col("s.last").alias("last"))


def address_segments(spark, sf):
    return _segments(spark, sf)


def address_numbers(spark, sf):
    """Distinct numbers without leading zeros in first-seen order, and the last postal code as it is written."""
    s = addresses.cleaned(F.col("a"))
    runs = F.regexp_extract_all(s, F.lit(r"(\d+)"), 1)
    postal = F.try_element_at(F.filter(runs, lambda t: F.length(t).isin(5, 6)), F.lit(-1))
    return _latin(spark, sf).select("entity_id", F.array_join(F.array_distinct(F.transform(runs, addresses.number)), " ").alias("numbers"), F.coalesce(postal, F.lit("")).alias("postal"))


def name_fields(spark, sf):
    own = [c for c in normalize.NORMALISED if c.startswith("name_")]
    return normalize.prepare(records(spark, sf).drop("region")).select("entity_id", *own)


def address_fields(spark, sf):
    own = ["addr_clean", "addr_alpha", "addr_numbers", "postal", "addr_landmark", "addr_nonlatin", "region"]
    return normalize.prepare(records(spark, sf).drop("region")).select("entity_id", *own)


def transliterate(spark, sf):
    return _latin(spark, sf).select("entity_id", F.col("n").alias("name"), F.md5("a").alias("address_md5"))


def eda_counts(spark, sf):
    rows = normalize.prepare(records(spark, sf).drop("region"))
    shares = ["empty_address", "nonlatin_name", "with_postal"]
    return metrics.record_counts(rows).withColumns({s: F.round(s, 6) for s in shares})


# Regions: parts, whose brand is the country, type the region and name the address.
REGION_COUNT, REGION_PURITY, REGION_SHARE = 5, 0.2, 0.15


def region_records(spark, sf):
    """Every fifth region is missing and every seventh ambiguous."""
    p = fx.table(spark, sf, "part")
    region = F.when(F.col("p_partkey") % 5 == 0, "").when(F.col("p_partkey") % 7 == 0, F.concat(F.lower("p_type"), F.lit("|promo"))).otherwise(F.lower("p_type"))
    return p.select(F.col("p_partkey").alias("entity_id"), (1 + F.col("p_partkey") % 3).alias("source"), F.col("p_brand").alias("country"), region.alias("region"), F.concat_ws(" ", "p_name", F.lower("p_brand"), F.lit("7"), F.lower("p_type")).alias("addr_clean"))


def _s1(df):
    return df.where("source = 1")


def region_freq(spark, sf):
    return regions.region_freq(_s1(region_records(spark, sf)))


def _resolved(spark, sf):
    rows = region_records(spark, sf)
    return regions.resolve(rows, regions.region_freq(_s1(rows)))


def region_resolve(spark, sf):
    return _resolved(spark, sf).select("entity_id", "region")


def region_rare(spark, sf):
    return regions.rare(_s1(_resolved(spark, sf)), REGION_SHARE)


def region_drop(spark, sf):
    rows = _resolved(spark, sf)
    return regions.drop(rows, regions.rare(_s1(rows), REGION_SHARE)).select("entity_id", "region")


def region_witness_fit(spark, sf):
    return regions.fit(_resolved(spark, sf), REGION_COUNT, REGION_PURITY)


def region_infer(spark, sf):
    return regions.infer(_resolved(spark, sf), REGION_COUNT, REGION_PURITY).select("entity_id", "region")


def region_subset(spark, sf):
    from linkweave.operators.sampling import dev_subset

    return dev_subset(_resolved(spark, sf), 0.5).select("entity_id", "region")


QUERIES = {f.__name__: f for f in (collapse_doubles, alt_split, name_tokens, name_core, legal_bits, nonlatin_flags, skeleton, address_segments, address_numbers, name_fields, address_fields, transliterate, eda_counts, region_freq, region_resolve, region_rare, region_drop, region_witness_fit, region_infer, region_subset)}

RECORDS_SQL = f"""rec0 AS (SELECT doc_id, lang, n_chars, REPLACE(COALESCE(text, ''), 'ß', 'ss') AS text FROM documents),
records AS (SELECT doc_id AS entity_id, 1 + doc_id % 3 AS source, lang AS country,
  REPLACE(SPLIT_PART(text, CHR(10), 1), '.', ' ') || ({q.strings(NAME_ENDS)})[doc_id % {len(NAME_ENDS)} + 1] AS business_name,
  REPLACE(SUBSTR(text, LENGTH(SPLIT_PART(text, CHR(10), 1)) + 2), '.', ' ') || ({q.strings(ADDRESS_ENDS)})[doc_id % {len(ADDRESS_ENDS)} + 1] AS business_address,
  CASE WHEN n_chars % 4 = 0 THEN '' ELSE 'r' || CAST(n_chars % 3 AS VARCHAR) END AS region FROM rec0),
lat AS (SELECT *, STRIP_ACCENTS(LOWER(business_name)) AS n, STRIP_ACCENTS(LOWER(business_address)) AS a FROM records)"""
_ALT = f"""{RECORDS_SQL}, nm AS (SELECT entity_id, REGEXP_REPLACE(n, '{vocabulary.MESSRS}', '') AS n FROM lat),
sp AS (SELECT *, REGEXP_MATCHES(n, '{vocabulary.ALTERNATE}') AS m, REGEXP_EXTRACT(n, '(?s)^(.*?){vocabulary.ALTERNATE}(.*)$', 1) AS b, REGEXP_EXTRACT(n, '(?s)^(.*?){vocabulary.ALTERNATE}(.*)$', 2) AS c FROM nm),
alt AS (SELECT entity_id, CASE WHEN NOT m THEN n WHEN TRIM(b) = '' AND TRIM(c) <> '' THEN c ELSE b END AS name,
  CASE WHEN m AND NOT (TRIM(b) = '' AND TRIM(c) <> '') THEN c ELSE '' END AS alt FROM sp)"""
_DOMAIN = vocabulary.DOMAIN
_CLEAN_NAME = f"REPLACE(REPLACE(REPLACE(REPLACE(REGEXP_REPLACE(name, '{_DOMAIN}', ' \\1 ', 'g'), '&', ' and '), '+', ' and '), '''', ''), '`', '')"
_TOKS = f"""{_ALT}, t0 AS (SELECT entity_id, {q.canonical(vocabulary.LEGAL, q.words(_CLEAN_NAME))} AS t FROM alt),
toks AS (SELECT entity_id, LIST_TRANSFORM(t, LAMBDA x, i: CASE WHEN x = 'li' AND LIST_CONTAINS({q.strings(vocabulary.LEGAL_KINDS)}, LIST_FILTER(t[1:i - 1], LAMBDA u: u <> 'li')[-1]) THEN 'ltd' ELSE x END) AS t FROM t0)"""
_CLEANED = f"REGEXP_REPLACE(REGEXP_REPLACE(a, '{vocabulary.JUNK}', ' ', 'g'), '{vocabulary.ORDINAL}', '\\1', 'g')"
_PARTS = """parts AS (SELECT p_partkey AS entity_id, 1 + p_partkey % 3 AS source, p_brand AS country,
  CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 7 = 0 THEN LOWER(p_type) || '|promo' ELSE LOWER(p_type) END AS region,
  p_name || ' ' || LOWER(p_brand) || ' 7 ' || LOWER(p_type) AS addr FROM part),
freq AS (SELECT country, region, COUNT(*) AS n FROM parts WHERE source = 1 AND region <> '' AND region NOT LIKE '%|%' GROUP BY 1, 2),
cand AS (SELECT entity_id, UNNEST(STRING_SPLIT(region, '|')) AS c FROM parts WHERE region LIKE '%|%'),
pick AS (SELECT entity_id, c FROM (SELECT cand.entity_id, c, ROW_NUMBER() OVER (PARTITION BY cand.entity_id ORDER BY COALESCE(n, 0) DESC, c) AS rk
  FROM cand JOIN parts USING (entity_id) LEFT JOIN freq ON freq.country = parts.country AND freq.region = c) WHERE rk = 1),
res AS (SELECT parts.* EXCLUDE (region), COALESCE(pick.c, region) AS region FROM parts LEFT JOIN pick USING (entity_id)),
rare AS (SELECT country, region FROM (SELECT country, region, COUNT(*) AS n, SUM(COUNT(*)) OVER (PARTITION BY country) AS t FROM res WHERE source = 1 AND region <> '' GROUP BY 1, 2)
  WHERE n < 0.15 * t)"""
_CODES = q.strings(set(vocabulary.REGIONS.values()))
_WITNESS = f"""wt AS (SELECT entity_id, country, LIST_TRANSFORM(l, LAMBDA x: CASE WHEN REGEXP_MATCHES(x, '^[0-9]+$') OR LENGTH(x) < 3 OR LIST_CONTAINS({_CODES}, x) THEN '' ELSE x END) AS t
  FROM (SELECT entity_id, country, STRING_SPLIT(addr, ' ')[-4:] AS l FROM res)),
wit AS (SELECT entity_id, country, UNNEST(LIST_FILTER(LIST_CONCAT(t, LIST_TRANSFORM(RANGE(1, LEN(t)), LAMBDA i: CASE WHEN t[i] <> '' AND t[i + 1] <> '' THEN t[i] || ' ' || t[i + 1] ELSE '' END)), LAMBDA x: x <> '')) AS w FROM wt)"""


def _pass(k: int, before: str) -> str:
    """One pass of learning witnesses and filling regions; `before` has entity_id, country, region."""
    return f"""fit{k} AS (SELECT country, w, region FROM (SELECT *, SUM(n) OVER (PARTITION BY country, w) AS tot, ROW_NUMBER() OVER (PARTITION BY country, w ORDER BY n DESC, region) AS rk
  FROM (SELECT wit.country, w, region, COUNT(*) AS n FROM wit JOIN {before} b USING (entity_id) WHERE region <> '' GROUP BY 1, 2, 3)) WHERE rk = 1 AND tot >= 5 AND n >= 0.2 * tot),
fill{k} AS (SELECT entity_id, MIN(f.region) AS r FROM wit JOIN fit{k} f USING (country, w) GROUP BY 1 HAVING COUNT(DISTINCT f.region) = 1),
inf{k} AS (SELECT b.entity_id, b.country, CASE WHEN b.region = '' THEN COALESCE(r, '') ELSE b.region END AS region FROM {before} b LEFT JOIN fill{k} USING (entity_id))"""


_STOP, _LEGAL = q.strings(vocabulary.NAME_STOP), q.strings(vocabulary.LEGAL_KINDS)
_BITS = "CASE x " + " ".join(f"WHEN '{t}' THEN {1 << b}" for b, t in enumerate(vocabulary.LEGAL_KINDS)) + " ELSE 0 END"
ORACLE_SQL = {
    "collapse_doubles": f"WITH {RECORDS_SQL} SELECT entity_id, {q.collapse('n')} AS name, MD5({q.collapse('a')}) AS address_md5 FROM lat",
    "alt_split": f"WITH {_ALT} SELECT entity_id, name, alt FROM alt",
    "name_tokens": f"WITH {_TOKS} SELECT entity_id, ARRAY_TO_STRING(t, ' ') AS name_clean FROM toks",
    "name_core": f"""WITH {_TOKS}, s AS (SELECT entity_id, t, LIST_FILTER(t, LAMBDA x: NOT LIST_CONTAINS({_STOP}, x)) AS o FROM toks),
      c AS (SELECT *, LIST_FILTER(o, LAMBDA x: NOT LIST_CONTAINS({_LEGAL}, x)) AS k FROM s)
      SELECT entity_id, ARRAY_TO_STRING(CASE WHEN LEN(k) > 0 THEN k WHEN LEN(o) > 0 THEN o ELSE t END, ' ') AS name_core FROM c""",
    "legal_bits": f"WITH {_TOKS}, x AS (SELECT entity_id, UNNEST(t) AS x FROM toks), b AS (SELECT entity_id, BIT_OR(CAST({_BITS} AS BIGINT)) AS b FROM x GROUP BY 1) SELECT entity_id, COALESCE(b, 0) AS name_legal FROM toks LEFT JOIN b USING (entity_id)",
    "nonlatin_flags": f"WITH {RECORDS_SQL} SELECT entity_id, REGEXP_MATCHES(business_name, '[^\\x{{0}}-\\x{{24F}}]') AS name_nonlatin FROM records",
    "skeleton": f"WITH {RECORDS_SQL}, w AS (SELECT DISTINCT UNNEST(LIST_CONCAT({q.words('n')}, {q.words('a')})) AS word FROM lat) SELECT word, {q.skeleton('word')} AS skeleton FROM w",
    "address_segments": f"""WITH {RECORDS_SQL}, c AS (SELECT entity_id, REGEXP_SPLIT_TO_ARRAY({_CLEANED}, '[,;\\n]') AS p FROM lat),
      e AS (SELECT entity_id, UNNEST(p) AS s, UNNEST(RANGE(LEN(p))) AS i FROM c),
      l AS (SELECT *, REGEXP_EXTRACT(s, '{vocabulary.LANDMARK}') AS lm, MAX(CASE WHEN TRIM(s) <> '' THEN i END) OVER (PARTITION BY entity_id) AS last_i FROM e)
      SELECT entity_id, i AS segment, lm AS landmark, ARRAY_TO_STRING({q.words(f"REGEXP_REPLACE(s, '{vocabulary.LANDMARK}', '')")}, ' ') AS words, i = COALESCE(last_i, -1) AS last FROM l""",
    "address_numbers": f"""WITH {RECORDS_SQL}, r AS (SELECT entity_id, REGEXP_EXTRACT_ALL({_CLEANED}, '\\d+') AS d FROM lat),
      z AS (SELECT entity_id, d, LIST_TRANSFORM(d, LAMBDA x: CASE WHEN LTRIM(x, '0') = '' THEN '0' ELSE LTRIM(x, '0') END) AS n FROM r)
      SELECT entity_id, ARRAY_TO_STRING(LIST_TRANSFORM(LIST_FILTER(LIST_TRANSFORM(n, LAMBDA x, i: CASE WHEN LIST_POSITION(n, x) = i THEN x END), LAMBDA x: x IS NOT NULL), LAMBDA x: x), ' ') AS numbers,
      COALESCE(LIST_FILTER(d, LAMBDA x: LENGTH(x) IN (5, 6))[-1], '') AS postal FROM z""",
    "transliterate": f"WITH {RECORDS_SQL} SELECT entity_id, n AS name, MD5(a) AS address_md5 FROM lat",
    "region_freq": f"WITH {_PARTS} SELECT country, region, n FROM freq",
    "region_resolve": f"WITH {_PARTS} SELECT entity_id, region FROM res",
    "region_rare": f"WITH {_PARTS} SELECT country, region FROM rare",
    "region_drop": f"WITH {_PARTS} SELECT res.entity_id, CASE WHEN rare.region IS NULL THEN res.region ELSE '' END AS region FROM res LEFT JOIN rare USING (country, region)",
    "region_witness_fit": f"WITH {_PARTS}, {_WITNESS}, {_pass(1, 'res')} SELECT country, w AS witness, region FROM fit1",
    "region_infer": f"WITH {_PARTS}, {_WITNESS}, {_pass(1, 'res')}, {_pass(2, 'inf1')} SELECT entity_id, region FROM inf2",
    "region_subset": f"""WITH {_PARTS}, g AS (SELECT DISTINCT country, region FROM res WHERE region <> ''),
      o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY country ORDER BY {q.hash_key("country || '|' || region")}, region) AS rk, COUNT(*) OVER (PARTITION BY country) AS n FROM g)
      SELECT entity_id, region FROM res WHERE region = '' OR (country, region) IN (SELECT (country, region) FROM o WHERE rk <= CEIL(n * 0.5))""",
}
