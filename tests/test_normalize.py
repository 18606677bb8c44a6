import pytest

from linkweave.functions import translit
from linkweave.operators.normalize import prepare

NAMES = [
    ("M/s. Shri Ramesh Traders Pvt. Ltd.", "shri ramesh traders pvt ltd", "ramesh traders", 16896, ""),
    ("oncologyphysicians.com", "oncologyphysicians", "oncologyphysicians", 0, ""),
    ("Acme S.A.R.L.", "acme sarl", "acme", 65536, ""),
    ("ACME Trading d/b/a Blue Sky Cafe LLC", "acme trading", "acme trading", 0, "blue sky cafe"),
    ("Oak Pra. Li.", "oak pvt ltd", "oak", 16896, ""),
    ("The Co", "the co", "co", 4, ""),
    ("", "", "", 0, ""),
    (None, "", "", 0, ""),
    ("d/b/a Blue Sky", "blue sky", "blue sky", 0, ""),
    ("Glisten & Sons + Co", "glisten and sons and co", "glisten sons", 4, ""),
]
ADDRESSES = [
    ("1600 Oak Ct, Springfield, IL 62704", "1600 oak court springfield 62704 il", "1600 62704", "62704", "", "il"),
    ("12 Oak Ct", "12 oak ct", "12", "", "", "ct"),
    ("12 Fl 0, Boston, MA 02134", "12 flor 0 boston 2134 ma", "12 0 2134", "", "", "ma"),
    ("Near Sayaji Hotel, Pune, Maharashtra 411001", "pune 411001 mh", "411001", "411001", "near sayaji hotel", "mh"),
    ("Oor, Howrah, West Bengal", "or howrah wb", "", "", "", "or|wb"),
    ("5th Floor No. 12, Rue de la Paix, Paris", "5 flor 12 rue de la paix paris", "5 12", "", "", ""),
    ("PO BOX 123, 45 Main St", "45 main stret", "45", "", "", ""),
    ("", "", "", "", "", ""),
    ("somewhere in new york city", "somewhere in ny city", "", "", "", "ny"),
    ("Hyderabad, TS", "hyderabad ts", "", "", "", "ap"),
]


@pytest.mark.parametrize("romanise", [True, False])
def test_names(spark, romanise):
    rows = [(i, n[0], "", " US ") for i, n in enumerate(NAMES)]
    df = spark.createDataFrame(rows, "entity_id int, business_name string, business_address string, country string")
    got = prepare(df, romanise).orderBy("entity_id").collect()
    assert [(r.name_clean, r.name_core, r.name_legal, r.name_alt) for r in got] == [n[1:] for n in NAMES]
    assert all(r.country_norm == "us" and r.name_compact == r.name_core.replace(" ", "") for r in got)


def test_addresses(spark):
    rows = [(i, "", a[0], "x") for i, a in enumerate(ADDRESSES)]
    df = spark.createDataFrame(rows, "entity_id int, business_name string, business_address string, country string")
    got = prepare(df, False).orderBy("entity_id").collect()
    assert [(r.addr_clean, r.addr_numbers, r.postal, r.addr_landmark, r.region) for r in got] == [a[1:] for a in ADDRESSES]


def test_romanised():
    assert translit.romanised("Café Ångström") == "cafe angstrom"
    assert translit.romanised("सेवन केयर") == "sevn keyr"
    assert translit.romanised("Straße Æther") == "strasse aether"
    assert translit.romanised("Москва").startswith("m") and translit.romanised("Москва").isascii()


def test_skeletons(spark):
    from pyspark.sql import functions as F

    from linkweave.functions.names import skeleton

    words = [("sevencare", "spnkr"), ("sevnkeyr", "spnkr"), ("builders", "pltrs"), ("piltrs", "pltrs"), ("vidyaalya", "ptl"), ("vidyalaya", "ptl"), ("", "")]
    got = spark.createDataFrame(words, "w string, s string").select("s", skeleton(F.col("w")).alias("k")).collect()
    assert all(r.s == r.k for r in got)


def test_legal_forms_of_a_long_name(spark):
    """Every word is read once: for each legal form anew, with a copy of the tokens before it, this took minutes."""
    import time

    from pyspark.sql import functions as F

    from linkweave.functions import names

    short = ["li pvt li li x li co ltd li", "pvt lix li", "", "sa", "co li incorporated"]
    long = " ".join(["word pvt li li"] * 20_000)
    df = spark.createDataFrame([(i, s) for i, s in enumerate([*short, long])], "i int, s string")
    began = time.time()
    got = df.orderBy("i").select(F.array_join(names.tokens(F.col("s")), " ").alias("t"), names.legal_bits(names.tokens(F.col("s"))).alias("b")).collect()
    assert time.time() - began < 20
    assert [tuple(r) for r in got[:-1]] == [("li pvt ltd ltd x li co ltd ltd", 16896 | 4), ("pvt lix li", 16384), ("", 0), ("sa", 1 << 15), ("co ltd inc", 4 | 512 | 64)]
    assert tuple(got[-1]) == (" ".join(["word pvt ltd ltd"] * 20_000), 16896)
