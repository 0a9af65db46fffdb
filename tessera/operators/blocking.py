"""Candidate generation: capped key joins, overlap joins, nearest neighbours, unions.

Keys of all kinds go through one join. The cap is checked on the side whose group sizes it bounds,
before the join, so a frequent key never makes its product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import wordlists as W


@dataclass(frozen=True)
class KeySpec:
    """A kind of key: its bit, its name, the most source-1 rows a key may have, and each side's array of keys."""

    bit: int
    name: str
    cap: int
    left: Column
    right: Column
    where: Column | None = None


def pairs_of(a: Column, b: Column) -> Column:
    """Every ``x|y`` of two arrays."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.concat_ws("|", x, y))))


def token_pairs(a: Column) -> Column:
    """Every unordered pair of an array's distinct values, in order."""
    s = F.array_sort(F.array_distinct(a))
    return F.flatten(F.transform(s, lambda x, i: F.transform(F.slice(s, i + 2, F.greatest(F.size(s) - i - 1, F.lit(0))), lambda y: F.concat_ws("|", x, y))))


def single(c: Column) -> Column:
    return F.when(c.isNotNull() & (c != ""), F.array(c)).otherwise(F.array().cast("array<string>"))


#: A number and the word after it, maybe with a letter between.
NUMBER_WORD = r"\p{Nd}+[a-z]?\s+(?:[a-z]\s+)?[\p{L}\p{M}]{2,}"


def number_words(address: Column) -> Column:
    """Each ``number word`` of an address, numbers without leading zeros."""
    return F.array_distinct(F.transform(F.regexp_extract_all(address, F.lit(NUMBER_WORD), F.lit(0)), lambda x: F.regexp_replace(x, r"^0+(?=\p{Nd})", "")))


def place_names(parts: Column) -> Column:
    """Address parts without a digit, in short forms and without words that name no place; three characters or more."""
    name = lambda x: X.collapse(F.array_join(X.mapped(F.filter(F.split(x, " "), lambda t: ~t.isin(W.PLACE_WORDS)), W.ADDRESS_CANON), " "))
    return F.array_distinct(F.filter(F.transform(parts, name), lambda x: ~x.rlike(r"\p{Nd}") & (F.length(x) >= 3)))


def keyed(df: DataFrame, specs: list[KeySpec], side: str) -> DataFrame:
    """(id, country, bit, cap, key) of all specs, each once for a row."""

    def structs(s: KeySpec) -> Column:
        return F.transform(F.array_distinct(s.left if side == "left" else s.right), lambda k: F.struct(F.lit(s.bit).alias("bit"), F.lit(s.cap).alias("cap"), k.alias("key")))

    arrays = [structs(s) for s in specs]
    arrays = [a if s.where is None else F.when(s.where, a).otherwise(F.array().cast("array<struct<bit:int,cap:int,key:string>>")) for a, s in zip(arrays, specs)]
    return df.select("id", "country", F.explode(F.concat(*arrays)).alias("k")).select("id", "country", "k.*").where("key IS NOT NULL AND key <> ''")


def capped_key_join(left: DataFrame, right: DataFrame, specs: list[KeySpec], keep: int = 50, more: DataFrame | None = None) -> DataFrame:
    """(s1, rec, keys, kscore): pairs that share a key of a country, for each record the ``keep`` most specific.

    ``n`` counts the left rows of a key and must not exceed its cap. ``keys`` has the bits of the
    kinds a pair meets by, ``kscore`` the sum over kinds of 1 / least n; ties go to the smaller id.
    ``more`` is (s1, rec, bit, weight): pairs of other searches, whose weight counts as it is.
    """
    l = keyed(left, specs, "left").withColumn("n", F.count("*").over(Window.partitionBy("country", "bit", "key"))).where("n <= cap")
    r = keyed(right, specs, "right").select(F.col("id").alias("rec"), "country", "bit", "key")
    met = l.select(F.col("id").alias("s1"), "country", "bit", "key", "n").join(r, ["country", "bit", "key"])
    kinds = met.groupBy("s1", "rec", "bit").agg(F.min("n").alias("n"))
    kinds = kinds.select("s1", "rec", "bit", (1 / F.col("n")).alias("weight"))
    kinds = kinds if more is None else kinds.unionByName(more)
    scored = kinds.groupBy("s1", "rec").agg(F.sum("bit").cast("long").alias("keys"), F.round(F.sum("weight"), 6).alias("kscore"))
    return top(scored, "rec", keep, F.desc("kscore"), "s1").drop("rn")


def top(df: DataFrame, by: str | list[str], k: int, *order) -> DataFrame:
    """The first ``k`` rows of each group, with their rank ``rn``."""
    w = Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def prune_tokens(right: DataFrame, tokens: Column, share: float, floor: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings, frequencies, sizes) of the right side; tokens in over max(share * N, floor) of its rows go."""
    posts = right.select(F.col("id").alias("rec"), "country", F.explode(F.array_distinct(tokens)).alias("tok"))
    df = posts.groupBy("country", "tok").agg(F.count("*").alias("df"))
    sizes = right.groupBy("country").agg(F.count("*").alias("n"))
    kept = df.join(sizes, "country").where(F.col("df") <= F.greatest(F.col("n") * share, F.lit(floor)))
    return posts, kept, sizes


def overlap_topk(left: DataFrame, right: DataFrame, tokens: Column, k: int = 15, share: float = 0.005, floor: int = 50, weight: str = "count") -> DataFrame:
    """(s1, rec, score, rn): for each left row the ``k`` right rows that share most tokens of its country.

    Weight ``count`` counts tokens, ``idf`` sums ln((N + 1) / (df + 1)) + 1. Frequent tokens are left
    out, which bounds what a token joins. Ties go to the smaller record.
    """
    posts, kept, _ = prune_tokens(right, tokens, share, floor)
    own = left.select(F.col("id").alias("s1"), "country", F.explode(F.array_distinct(tokens)).alias("tok")).join(kept, ["country", "tok"])
    value = F.lit(1) if weight == "count" else F.ln((F.col("n") + 1) / (F.col("df") + 1)) + 1
    total = F.sum("value")
    scored = own.withColumn("value", value).join(posts, ["country", "tok"]).groupBy("s1", "rec").agg((total if weight == "count" else F.round(total, 6)).alias("score"))
    return top(scored, "s1", k, F.desc("score"), "rec")


def shared_values(left: DataFrame, right: DataFrame, values: Column) -> DataFrame:
    """(country, value, side, id, links): the rows of each of ``values`` that both sides have in a country.

    A value is a class: every row of side 1 in it is linked to every row of side 2, and ``links``
    counts those of a row. So no link is left out however many rows share a value, and no product is
    made; a value is counted before its rows meet the counts. :func:`value_pairs` spells out pairs.
    """
    rows = lambda d, n: d.select("country", F.explode(F.array_distinct(values)).alias("value"), F.lit(n).alias("side"), "id")
    both = rows(left, 1).unionByName(rows(right, 2))
    counts = both.groupBy("country", "value").agg(F.count_if(F.col("side") == 1).alias("n1"), F.count_if(F.col("side") == 2).alias("n2")).where("n1 > 0 AND n2 > 0")
    return both.join(counts, ["country", "value"]).select("country", "value", "side", "id", F.when(F.col("side") == 1, F.col("n2")).otherwise(F.col("n1")).alias("links"))


def value_pairs(classes: DataFrame) -> DataFrame:
    """(s1, rec) of :func:`shared_values`, each once: the product of each class, for classes known to be small."""
    one = classes.where("side = 1").select("country", "value", F.col("id").alias("s1"))
    return one.join(classes.where("side = 2").select("country", "value", F.col("id").alias("rec")), ["country", "value"]).select("s1", "rec").distinct()


#: Distinct bags of a block on the side that is searched, and of one on the side that asks.
INDEX_BAGS, QUERY_BAGS = 1 << 17, 1 << 16
#: Between a country and a gram of it.
MARK = "\0"


def bag_classes(d: DataFrame, grams: Column) -> DataFrame:
    """(rep, bag, ids): the rows of ``d`` by equal bags of ``country, gram``, each bag sorted; ``rep`` is the least of the sorted ids."""
    marked = F.filter(F.transform(grams, lambda g: F.concat(F.col("country"), F.lit(MARK), g)), lambda x: x.isNotNull())
    bags = d.select("id", marked.alias("bag")).groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("bag"))).alias("bag"))
    return bags.where(F.size("bag") > 0).groupBy("bag").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "bag", "ids")


@dataclass
class Bags:
    """Vectors of length one in rows: the rows' names in order, where each row starts, and the terms (numbers into ``words``) and weights of all."""

    reps: np.ndarray
    starts: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    words: pa.Array

    @classmethod
    def of(cls, t: pa.Table) -> Bags:
        t = t.sort_by("rep").combine_chunks()
        sizes = pc.list_value_length(t["w"]).to_numpy().astype(np.int64)
        coded, w = pc.list_flatten(t["f"]).combine_chunks().dictionary_encode(), pc.list_flatten(t["w"]).to_numpy()
        starts = np.concatenate([[0], np.cumsum(sizes)])
        lengths = np.sqrt(np.add.reduceat(w * w, starts[:-1]) if len(sizes) else w)
        return cls(t["rep"].to_numpy(), starts, coded.indices.to_numpy().astype(np.int64), w / np.repeat(lengths, sizes), coded.dictionary)

    def nearest(self, asked: Bags, k: int, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(rep of ``asked``, reps, cosines) of the ``k`` highest cosines of ``least`` or more; ties go to the smaller rep.

        Each term has the list of the rows that hold it, and a row that asks sums over its terms' lists.
        """
        order = np.argsort(self.terms, kind="stable")
        rows, weights = np.repeat(np.arange(len(self.reps)), np.diff(self.starts))[order], self.weights[order]
        ends = np.concatenate([[0], np.cumsum(np.bincount(self.terms, minlength=len(self.words)))]).tolist()
        known = pc.fill_null(pc.index_in(asked.words, value_set=self.words), -1).to_numpy()[asked.terms]
        for q, (i, j) in enumerate(zip(asked.starts.tolist(), asked.starts[1:].tolist())):
            at = [slice(ends[x], ends[x + 1]) for x in known[i:j].tolist() if x >= 0]
            if not at:
                continue
            sums = np.bincount(np.concatenate([rows[s] for s in at]), np.concatenate([weights[s] * u for s, u in zip(at, asked.weights[i:j][known[i:j] >= 0].tolist())]), len(self.reps))
            found = np.flatnonzero(sums >= least - 1e-6)
            cos = np.floor(sums[found] * 1e6 + 0.5) / 1e6
            floor = max(least, np.partition(cos, -k)[-k]) if len(cos) > k else least
            found, cos = found[cos >= floor], cos[cos >= floor]
            best = np.argsort(-cos, kind="stable")[:k]
            if len(best):
                yield asked.reps[q], self.reps[found[best]], cos[best]


def tfidf_knn(left: DataFrame, right: DataFrame, grams: Column, k: int = 5, min_df: int = 2, max_share: float = 0.05, least: float = 0.5) -> DataFrame:
    """(s1, rec, cos, rn): for each record the ``k`` left rows of the highest TF-IDF cosine, ``least`` at least; exact.

    ``grams`` is an array with repeats; the vocabulary is the left side's: tf = 1 + ln(count), idf =
    ln((1 + N) / (1 + df)) + 1, vectors of length one. Rows of equal bags are one class. Classes are
    cut into blocks; every two blocks are one task, which sums products in place and of which the
    ``k`` nearest classes of each class go on, so no pair is moved that is not among these. Since a
    class goes by its least id, the ``k`` nearest rows are in the ``k`` nearest classes.
    """
    sizes = left.groupBy("country").agg(F.count("*").alias("n"))
    l, r = bag_classes(left, grams), bag_classes(right, grams)
    df = l.select(F.explode(F.array_distinct("bag")).alias("f"), F.size("ids").alias("m")).groupBy("f").agg(F.sum("m").alias("df"))
    vocabulary = df.withColumn("country", F.substring_index("f", MARK, 1)).join(sizes, "country").where((F.col("df") >= min_df) & (F.col("df") <= max_share * F.col("n")))
    vocabulary = vocabulary.select("f", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))

    def vectors(classes: DataFrame, other: int, own: int, mine: str, theirs: str) -> DataFrame:
        """(rep, f, w) in block ``mine``, once for each block of the other side."""
        each = classes.select("rep", F.explode("bag").alias("f")).join(vocabulary, "f").repartition("rep")
        terms = each.groupBy("rep", "f").agg(F.first("idf").alias("idf"), F.count("*").alias("tf")).select("rep", F.struct("f", ((1 + F.ln("tf")) * F.col("idf")).alias("w")).alias("t"))
        rows = terms.groupBy("rep").agg(F.collect_list("t").alias("t")).select("rep", F.col("t.f").alias("f"), F.col("t.w").alias("w"), F.pmod(F.xxhash64("rep"), F.lit(own)).cast("int").alias(mine))
        return rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias(theirs))

    def product(a: pa.Table, b: pa.Table) -> pa.Table:
        found = list(Bags.of(a).nearest(Bags.of(b), k, least)) if len(a) and len(b) else []
        none = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        q, s, c = ([np.full(len(x), q) for q, x, _ in found], [x for _, x, _ in found], [c for _, _, c in found])
        return pa.table(dict(zip(("q", "s", "cos"), (np.concatenate([z, *x]) for z, x in zip(none, (q, s, c))))))

    m, n = left.count() // INDEX_BAGS + 1, right.count() // QUERY_BAGS + 1
    pairs = vectors(l, n, m, "i", "j").groupBy("i", "j").cogroup(vectors(r, m, n, "j", "i").groupBy("i", "j"))
    near = top(pairs.applyInArrow(product, "q long, s long, cos double"), "q", k, F.desc("cos"), "s").drop("rn")
    rows = near.join(l.select(F.col("rep").alias("s"), F.slice("ids", 1, k).alias("ids")), "s").select("q", "cos", F.explode("ids").alias("s1"))
    best = top(rows, "q", k, F.desc("cos"), "s1")
    return best.join(r.select(F.col("rep").alias("q"), F.explode("ids").alias("rec")), "q").select("s1", "rec", "cos", "rn")


#: Vectors of a block on either side of a comparison.
BLOCK_VECTORS = 4096


def vector_knn(left: DataFrame, right: DataFrame, k: int = 5) -> DataFrame:
    """(s1, rec, cos, rn): for each left vector the ``k`` right ones of the highest cosine, itself left out; exact.

    Sides have (id, vec), vectors of one length. Both are cut into blocks; every two blocks are one
    matrix product, of which each left row's best go on, so what is sorted is ``k`` rows a block.
    Null vectors and those of length zero have no neighbours. Ties go to the smaller record.
    """

    def cut(d: DataFrame, other: int, own: int, mine: str, theirs: str) -> DataFrame:
        kept = d.where(F.col("vec").isNotNull()).select("id", F.col("vec").cast("array<double>").alias("vec"), F.pmod(F.xxhash64("id"), F.lit(own)).cast("int").alias(mine))
        return kept.select("*", F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias(theirs))

    def unit(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids, v = t["id"].to_numpy(), t["vec"].combine_chunks()
        v = np.asarray(v.flatten()).reshape(len(ids), -1) if len(ids) else np.zeros((0, 1))
        size = np.sqrt((v * v).sum(axis=1))
        return ids[size > 0], v[size > 0] / size[size > 0, None]

    def product(a: pa.Table, b: pa.Table) -> pa.Table:
        (s1, x), (rec, y) = unit(a), unit(b)
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if len(s1) and len(rec):
            order = np.argsort(rec)
            rec, y = rec[order], y[order]
            cos = np.round(x @ y.T, 6)
            cos[s1[:, None] == rec[None, :]] = -2
            best = np.argsort(-cos, axis=1, kind="stable")[:, :k]
            out = [np.repeat(s1, best.shape[1]), rec[best].reshape(-1), np.take_along_axis(cos, best, axis=1).reshape(-1)]
            out = [c[out[2] > -2] for c in out]
        return pa.table({"s1": out[0], "rec": out[1], "cos": out[2]})

    m, n = (d.count() // BLOCK_VECTORS + 1 for d in (left, right))
    pairs = cut(left, n, m, "i", "j").groupBy("i", "j").cogroup(cut(right, m, n, "j", "i").groupBy("i", "j"))
    return top(pairs.applyInArrow(product, "s1 long, rec long, cos double"), "s1", k, F.desc("cos"), "rec")


def union_candidates(tokens: DataFrame, vectors: DataFrame, mode: str, cap: int) -> DataFrame:
    """(s1, rec, token, cos, score, rn): candidates of two searches together.

    ``tokens`` is (s1, rec, token), ``vectors`` (s1, rec, cos). ``fused`` scores half of token (1 where
    met) plus cosine; ``priority`` 3 for both, 2 for tokens, 1 for vectors, then by cosine.
    """
    both = tokens.join(vectors, ["s1", "rec"], "full_outer").select("s1", "rec", F.coalesce("token", F.lit(0.0)).alias("token"), F.coalesce("cos", F.lit(0.0)).alias("cos"), F.col("token").isNotNull().alias("t"), F.col("cos").isNotNull().alias("v"))
    if mode == "fused":
        scored = both.withColumn("score", X.rounded(0.5 * F.col("token") + F.col("cos")))
    else:
        scored = both.withColumn("score", F.when(F.col("t") & F.col("v"), 3).when(F.col("t"), 2).otherwise(1).cast("double"))
    return top(scored, "s1", cap, F.desc("score"), F.desc("cos"), "rec").drop("t", "v")


def standard_specs(regions: bool = True) -> list[KeySpec]:
    """Key specs over a table with core, core_tok, all_tok, rare, nums, concat, ad, cities, atok, arare, sounds.

    The left side uses the rarest tokens of a row, the right side all: ``rare`` two name tokens,
    ``rare3`` those of three that are not too frequent, ``arare`` those of two address tokens that are
    rare, ``arare3`` three. ``few_tok`` are the name tokens
    of a known frequency that is not too high.
    """
    c = F.col
    nums_sig = F.when(F.size("nums") >= 2, F.array(F.array_join(F.array_sort("nums"), " "))).otherwise(F.array().cast("array<string>"))
    prefix = F.when(F.length("concat") >= 6, F.array(F.left("concat", F.lit(7)))).otherwise(F.array().cast("array<string>"))
    few = lambda a: F.when(F.size(a) <= 8, token_pairs(a)).otherwise(F.array().cast("array<string>"))
    return [
        KeySpec(1, "hs", 100, number_words(c("ad")), number_words(c("ad"))),
        KeySpec(2, "hr", 100, pairs_of(c("nums"), c("rare")), pairs_of(c("nums"), c("all_tok"))),
        KeySpec(4, "core", 100, single(F.array_join(F.array_sort("core_tok"), " ")), single(F.array_join(F.array_sort("core_tok"), " "))),
        KeySpec(8, "nums", 100, nums_sig, nums_sig),
        KeySpec(16, "ph", 100, pairs_of(c("nums"), c("rare_sounds")), pairs_of(c("nums"), c("sounds"))),
        KeySpec(32, "cat", 100, prefix, prefix),
        KeySpec(64, "cr", 100, pairs_of(c("cities"), c("rare")), pairs_of(c("cities"), c("all_tok"))),
        KeySpec(128, "r", 25, c("rare"), c("all_tok")),
        KeySpec(256, "hc", 100, pairs_of(c("nums"), c("cities")), pairs_of(c("nums"), c("cities"))),
        KeySpec(512, "at", 25, c("arare"), c("atok")),
        KeySpec(1024, "atn", 100, pairs_of(c("arare"), c("nums")), pairs_of(c("atok"), c("nums"))),
        KeySpec(2048, "rp", 30, token_pairs(c("rare3")), few(c("few_tok"))),
        KeySpec(4096, "atc", 100, pairs_of(c("arare3"), c("cities")), pairs_of(c("atok"), c("cities"))),
    ]


#: A number and the first word after it that names the street; the start of a street line, by its number and by its kind.
FRENCH_NUMBER_WORD = rf"\p{{Nd}}+[a-z]?\s+(?:(?:{'|'.join(W.FRENCH_SKIP)})\s+)*[\p{{L}}\p{{M}}]{{2,}}"
FRENCH_NUMBERED = r"^(?:no?\s+)?0*(\p{Nd}+)"
FRENCH_TYPED = rf"^(?:no?\s+)?\p{{Nd}}*[a-z]?\s*(?:{'|'.join(W.FRENCH_TYPES)})( |$|[^\p{{L}}\p{{M}}\p{{N}}_])"


def french_streets(address: Column, parts: Column) -> tuple[Column, Column, Column]:
    """(number first-word, first and last words, number last-word) of street lines, passing over kinds of street and articles.

    A line is a part of the address with a number at its start or a kind of street.
    """
    first = F.transform(F.regexp_extract_all(address, F.lit(FRENCH_NUMBER_WORD), F.lit(0)), lambda x: F.concat(F.regexp_extract(x, r"^0*(\p{Nd}+)", 1), F.lit(" "), F.element_at(F.split(x, r"\s+"), -1)))
    line = F.filter(parts, lambda x: x.rlike(FRENCH_NUMBERED) | x.rlike(FRENCH_TYPED))
    names = lambda x: F.filter(F.split(x, " "), lambda w: w.rlike(r"^[\p{L}\p{M}]{3,}$") & ~w.isin([*W.FRENCH_SKIP, *W.FRENCH_NUMBER]))
    told = F.filter(F.transform(line, lambda x: F.struct(F.nullif(F.regexp_extract(x, FRENCH_NUMBERED, 1), F.lit("")).alias("number"), names(x).alias("names"))), lambda x: F.size(x["names"]) > 0)
    ends = F.flatten(F.transform(told, lambda x: F.array(F.get(x["names"], F.lit(0)), F.element_at(x["names"], -1))))
    last = F.transform(F.filter(told, lambda x: x["number"].isNotNull()), lambda x: F.concat(x["number"], F.lit(" "), F.element_at(x["names"], -1)))
    return F.array_distinct(first), F.array_distinct(ends), F.array_distinct(last)


def french_specs() -> list[KeySpec]:
    by_first, names, by_last = french_streets(F.col("ad"), F.col("parts"))
    here = F.col("country") == "fr"
    return [
        KeySpec(16384, "hsf", 100, by_first, by_first, here),
        KeySpec(32768, "sfc", 100, pairs_of(names, F.col("cities")), pairs_of(names, F.col("cities")), here),
        KeySpec(65536, "hsfl", 100, by_last, by_last, here),
    ]


#: A name token of a pair is in so many rows of its country at most, an address token that is a key in so many.
PAIR_FREQUENCY, ADDRESS_FREQUENCY = 20_000, 300


def key_parts(norm: DataFrame, freq: DataFrame, afreq: DataFrame, regions: DataFrame) -> DataFrame:
    """What key specs draw on, by row: ``norm`` with lists of tokens by their frequencies (country, tok, freq).

    Frequencies of a row's tokens come by one join for names and one for addresses; ranks are taken in
    the row's own arrays.
    """
    empty = F.array().cast("array<string>")
    out = norm.join(regions.select("id", F.col("rest").alias("parts")), "id", "left").withColumn("parts", F.coalesce("parts", empty))
    out = out.withColumn("all_tok", F.array_distinct(F.concat("core_tok", "alias_tok"))).withColumn("atok", address_tokens(F.col("parts"))).withColumn("ad", F.array_join("parts", " "))

    def ranked(column: str, tokens: Column, table: DataFrame) -> DataFrame:
        each = out.select("id", "country", F.explode(tokens).alias("tok")).join(table, ["country", "tok"])
        return each.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("freq", "tok"))).alias(column))

    out = out.join(ranked("ftok", F.col("all_tok"), freq), "id", "left").join(ranked("fatok", F.col("atok"), afreq), "id", "left")
    out = out.withColumns({c: F.coalesce(c, F.array().cast("array<struct<freq:bigint,tok:string>>")) for c in ("ftok", "fatok")})
    names = lambda column, k, most=None: F.array_sort(F.transform(F.filter(F.slice(column, 1, k), lambda x: F.lit(True) if most is None else x["freq"] <= most), lambda x: x["tok"]))
    out = out.withColumn("own", F.filter("ftok", lambda x: F.array_contains("core_tok", x["tok"])))
    return out.withColumns({
        "rare": names("own", 2), "rare3": names("own", 3, PAIR_FREQUENCY), "arare": names("fatok", 2, ADDRESS_FREQUENCY), "arare3": names("fatok", 3),
        "few_tok": F.transform(F.filter("ftok", lambda x: x["freq"] <= PAIR_FREQUENCY), lambda x: x["tok"]), "cities": place_names(F.col("parts")), "sounds": empty, "rare_sounds": empty,
    }).drop("ftok", "fatok", "own")


def address_tokens(parts: Column) -> Column:
    """Short forms of the words of an address, three letters or more, each once."""
    return F.array_distinct(F.filter(X.mapped(F.flatten(F.transform(parts, lambda x: F.split(x, " "))), W.ADDRESS_CANON), lambda x: x.rlike(r"^\p{L}{3,}$")))


def add_sounds(parts: DataFrame) -> DataFrame:
    """Fill ``sounds`` and ``rare_sounds`` of :func:`key_parts`: metaphones of ASCII name tokens of three letters or more, of all and of the rarest."""
    from tessera.functions.kernels import metaphone

    toks = parts.select("id", F.explode("all_tok").alias("tok"), "rare").where("tok rlike '^[a-z]{3,}$'")
    codes = toks.select("tok").distinct().withColumn("code", metaphone(F.col("tok")))
    lists = toks.join(codes, "tok").where("code <> ''").groupBy("id").agg(F.array_sort(F.collect_set("code")).alias("codes"), F.array_sort(F.collect_set(F.when(F.array_contains("rare", F.col("tok")), F.col("code")))).alias("rare_codes"))
    none = F.array().cast("array<string>")
    out = parts.drop("sounds", "rare_sounds").join(lists, "id", "left")
    return out.withColumn("sounds", F.coalesce("codes", none)).withColumn("rare_sounds", F.coalesce("rare_codes", none)).drop("codes", "rare_codes")
