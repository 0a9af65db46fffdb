import pytest
from pyspark.sql import functions as F

from tessera.functions import kernels as K
from tessera.functions import text as X
from tessera.operators import normalize as N


def values(spark, texts, make):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", make(F.col("t")).alias("v")).orderBy("i").collect()]


def test_unicode_text_keeps_other_scripts(spark):
    got = values(spark, ["राम मार्केटिंग प्राइवेट लिमिटेड", "ABC Company", "AbC CoMpAnY", "-- Holloway Peak Inc", "ﬁne Co", None, "  "], X.unicode_text)
    assert got == ["राम मार्केटिंग प्राइवेट लिमिटेड", "abc company", "abc company", "holloway peak inc", "fine co", "", ""]
    tokens = values(spark, ["ಶ್ರೀ ಟ್ರೇಡರ್ಸ್", "orelee's [a]|b_c", "M/s Basera Advisors उत्तर प्रदेश"], lambda c: X.tokenize(X.unicode_text(c)))
    assert len(tokens[0]) == 2 and tokens[1] == ["orelee", "s", "a", "b_c"] and {"basera", "उत्तर"} <= set(tokens[2])


def test_web_parts_go(spark):
    assert values(spark, ["www.acme.com", "shop.in town", "inn.house"], X.unicode_text) == ["acme", "shop town", "inn.house"]


def test_legal_forms_and_generic_words(spark):
    canon = values(spark, ["x private limited", "x pvt ltd", "corporation of x"], lambda c: X.legal_canon(X.tokenize(c)))
    assert canon == [["x", "pvt", "ltd"], ["x", "pvt", "ltd"], ["corp", "of", "x"]]
    assert values(spark, ["acme services india 42 7a"], lambda c: X.search_tokens(X.tokenize(c))) == [["acme", "42", "7a"]]
    assert values(spark, ["acme 42 7a 42"], lambda c: X.digit_tokens(X.tokenize(c))) == [["42"]]


def test_folds(spark):
    assert values(spark, ["Élan Ñandú", "राम", None, "Straße"], X.fold) == ["elan nandu", "राम", None, "straße"]
    assert values(spark, ["Élan  Ñandú", "राम x", "Straße"], X.ascii_fold) == ["elan nandu", "x", "strae"]


def test_names(spark):
    df = spark.createDataFrame([(1, "US", 1, "The Acme & Co. L.L.C. dba Foo Bar Inc", "012 N Main Street, Apt 04, null, New Town, Texas"), (2, "US", 2, "dba Zed", None), (3, "US", 2, None, ",, ,")], "id long, country string, src int, name string, address string")
    a, b, c = N.normalize(df).orderBy("id").collect()
    assert (a.core, a.alias, a.has_alias, a.nums, a.hnum, a.street, a.comps) == ("acme", "foo bar", True, ["12", "4"], "12", "main", ["012 n main street", "apt 04", "new town", "texas"])
    assert (b.core, b.comps, b.addr_empty) == ("zed", [], True) and (c.core, c.comps) == ("", [])


def test_core_names_by_rule(spark):
    cases = {
        "acme.co.in": "acme", "shop foo.com.in x": "shop foo x", "www.acme.com": "acme", "www.com": "com", "http://foo.org/bar": "foo bar", "a.coming": "a coming", ".com": "", "x.com_y": "x com y",
        "acme l.l.c.": "acme", "acme l l p": "acme", "acme l. l. c": "acme", "acme ll.c": "acme", "acme l lc x": "acme x", "l l l c": "", "acme c p": "acme c p", "acme llcx": "acme llcx", "ll": "ll",
        "acme (id: 12) b": "acme b", "a & b": "a b", "": "", "-- x": "x", "the (id 7)": "", "kwww.foo": "kwww foo", "www": "www", "sons l.-l.c": "sons c",
    }
    assert dict(zip(cases, values(spark, cases, X.core_name))) == cases


def test_aliases_split_once(spark):
    cases = {
        "acme (dba) foo": ["acme (", ") foo"], "acme,dba foo": ["acme,", "foo"], "acme-dba foo": ["acme-", "foo"], "acme dba: foo aka bar": ["acme", "foo aka bar"], "akash": ["akash"], "x formerly known as y": ["x", "y"],
        "dba zed": ["", "zed"], "neenee": ["neenee"], "a d/b/a b": ["a", "b"],
    }
    assert dict(zip(cases, values(spark, cases, X.alias_parts))) == cases


def test_address_parts_and_numbers_by_rule(spark):
    cases = {"null null main st": ["main st"], "n/a n/a": [], "null, nullx, a-n/a": ["nullx", "a"], " 1/2 - x -, (y)": ["1/2 - x", "y"], "a..b": ["a b"]}
    assert dict(zip(cases, values(spark, cases, X.components))) == cases
    assert values(spark, ["flat १२३ road", "007 0 00 07", "०१", ""], X.numbers) == [["१२३"], ["7", "0"], ["०१"], []]
    assert values(spark, ["12 n main st", "12a street", "१२ rue", "main", "12 x"], X.street_word) == ["main", "st", "r", None, None]
    assert values(spark, ["a.in", "a.inn", "x @b", "#b", "x@b", "x # b", "WWW.x", "a.net"], X.is_web) == [True, False, True, True, False, False, True, True]
    assert values(spark, ["foo.com.in", None], X.spell_domain) == ["foo com .in", None]


@pytest.mark.parametrize("address,want", [
    (None, (False, None, [], None)), (" ", (False, None, [], None)), (",,;,", (False, None, [], None)), ("One", (True, "one", [], "one")), ("One, Two", (True, "one", [], "two")),
    ("12 High St,  Flat 2 ,, Town, Land.", (True, "12 high st", ["flat 2", "town"], "land")),
])
def test_address_parts(spark, address, want):
    (got,) = values(spark, [address], X.address_parts)
    assert tuple(got) == want


def test_composite_key_needs_all_parts(spark):
    df = spark.createDataFrame([("a", "b"), ("a", ""), (None, "b")], "x string, y string")
    assert [r.k for r in df.select(X.composite(F.col("x"), F.col("y")).alias("k")).collect()] == ["a|b", None, None]


def brute_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_kernels():
    import random

    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(12))) for _ in range(2))
        assert K.common_length(a, b) == brute_lcs(a, b)
        for f in K.KERNELS.values():
            assert 0 <= f(a, b) <= 1 + 1e-9
        assert K.token_sort(a, b) == K.token_sort(b, a) and K.token_set(a, b) == pytest.approx(K.token_set(b, a))
        assert not a or K.partial(a, f"xy{a}zz") == 1
    assert K.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert K.jaro_winkler("dixon", "dicksonx") == pytest.approx(0.813333, abs=1e-6)
    assert all(f("", "x") == 0 and f("x", "") == 0 and f("same text", "same text") == 1 for f in K.KERNELS.values())
    assert (K.sound("knight"), K.sound("phone"), K.sound("thumb"), K.sound("")) == ("NT", "FN", "0M", "")
    assert (K.indic_word("राम"), K.indic_word("मार्केटिंग")) == ("ram", "marketing")


def test_native_kernels(spark):
    df = spark.createDataFrame([(["a", "b"], ["b"], "kitten", "sitting"), ([], [], "", "x")], "a array<string>, b array<string>, s string, t string")
    c = F.col
    rows = df.select(K.jaccard(c("a"), c("b")), K.containment(c("a"), c("b")), K.levenshtein_similarity(c("s"), c("t")), K.dice(c("s"), c("t")), K.length_ratio(c("s"), c("t"))).collect()
    assert tuple(rows[0]) == pytest.approx((0.5, 1.0, 1 - 3 / 7, 2 / 9, 1 / 7), abs=1e-9)
    assert tuple(rows[1]) == (0, 0, 0, 0, 1)


def test_transliteration_by_dictionary_and_rule(spark):
    assert values(spark, ["राम stores", "plain", None], lambda c: K.transliterate(c, {"राम": "raam"})) == ["raam stores", "plain", None]
