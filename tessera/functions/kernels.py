"""Similarity kernels: native where Spark has what they need, else one Arrow function over pairs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import grams


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 0 where a side is empty or null."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return F.when((a != "") & (b != ""), 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))).otherwise(F.lit(0.0))


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance, -1 where a side is missing."""
    return F.coalesce(F.levenshtein(a, b), F.lit(-1))


def dice(a: Column, b: Column) -> Column:
    """Of trigram sets; 0 where a side has none."""
    x, y = grams(a), grams(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), 2 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))).otherwise(F.lit(0.0))


def length_ratio(a: Column, b: Column) -> Column:
    return F.abs(F.length(a) - F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))


def cosine(a: Column, b: Column) -> Column:
    """Of two vectors, in doubles; 0 where one is all zeros."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def initials_match(concat: Column, initials: Column) -> Column:
    return (F.length(concat) >= 2) & (concat == initials)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column, eps: float = 1e-6) -> Column:
    c = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.ln(c / (1 - c))


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & where.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def ratio(a: str, b: str) -> float:
    return 2 * common_length(a, b) / (len(a) + len(b)) if a and b else 0.0


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 1.0
    left, right = (" ".join([*([both] if both else []), *sorted(s)]) for s in (x - y, y - x))
    return max(ratio(left, right), ratio(both, left), ratio(both, right))


def partial(a: str, b: str) -> float:
    """The best ratio of the shorter text and a stretch of the longer, cut short at its edges."""
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    n = len(a)
    return max(ratio(a, b[max(0, i) : i + n]) for i in range(1 - n, len(b)))


def jaro_winkler(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, t in zip(b, taken) if t]
    m, swaps = len(left), sum(x != y for x, y in zip(left, right)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


KERNELS = {"ratio": ratio, "token_sort": token_sort, "token_set": token_set, "partial": partial, "jaro_winkler": jaro_winkler}


def string_similarities(a: Column, b: Column, names: tuple[str, ...] = tuple(KERNELS)) -> Column:
    """A struct of the named kernels of two texts, in one pass; null counts as empty, and empty gives 0."""
    fields = [pa.field(n, pa.float64()) for n in names]

    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        pairs = [(p or "", q or "") for p, q in zip(x.to_pylist(), y.to_pylist())]
        known: dict = {}
        for p in set(pairs):
            known[p] = [KERNELS[n](*p) for n in names]
        columns = list(zip(*[known[p] for p in pairs])) or [()] * len(names)
        return pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in columns], fields=fields)

    return F.arrow_udf(run, "struct<" + ",".join(f"{n}:double" for n in names) + ">")(a, b)


_VOWELS = set("AEIOU")


def sound(word: str) -> str:
    """A consonant skeleton by the public Metaphone rules, for ASCII words."""
    w = "".join(c for c in word.upper() if "A" <= c <= "Z")
    for lead, to in (("KN", "N"), ("GN", "N"), ("PN", "N"), ("AE", "E"), ("WR", "R"), ("WH", "W"), ("X", "S")):
        if w.startswith(lead):
            w = to + w[len(lead) :]
            break
    out, i, n = [], 0, len(w)
    at = lambda k: w[k] if 0 <= k < n else ""
    while i < n:
        c, code = w[i], ""
        if c == at(i - 1) and c != "C":
            i += 1
            continue
        if c in _VOWELS:
            code = c if i == 0 else ""
        elif c == "B":
            code = "" if at(i - 1) == "M" and i == n - 1 else "B"
        elif c == "C":
            code = "X" if at(i + 1) == "H" or w[i : i + 3] == "CIA" else "S" if at(i + 1) in "IEY" and at(i + 1) and at(i - 1) != "S" else "" if at(i - 1) == "S" and at(i + 1) in "IEY" and at(i + 1) else "K"
        elif c == "D":
            code = "J" if at(i + 1) == "G" and at(i + 2) in "EYI" and at(i + 2) else "T"
        elif c == "G":
            silent = at(i + 1) == "H" and at(i + 2) not in _VOWELS or at(i + 1) == "N" and i + 2 >= n
            code = "" if silent else "J" if at(i + 1) in "IEY" and at(i + 1) and at(i - 1) != "G" else "K"
        elif c == "H":
            code = "H" if at(i + 1) in _VOWELS and at(i - 1) not in set("CSPTG") else ""
        elif c == "K":
            code = "" if at(i - 1) == "C" else "K"
        elif c == "P":
            code = "F" if at(i + 1) == "H" else "P"
        elif c == "Q":
            code = "K"
        elif c == "S":
            code = "X" if at(i + 1) == "H" or w[i : i + 3] in ("SIO", "SIA") else "S"
        elif c == "T":
            code = "X" if w[i : i + 3] in ("TIA", "TIO") else "0" if at(i + 1) == "H" else "" if w[i : i + 3] == "TCH" else "T"
        elif c == "V":
            code = "F"
        elif c in "WY":
            code = c if at(i + 1) in _VOWELS else ""
        elif c == "X":
            code = "KS"
        elif c == "Z":
            code = "S"
        elif c in "FJLMNR":
            code = c
        out.append(code)
        i += 1
    return "".join(out)


def metaphone(c: Column) -> Column:
    def run(x: pa.Array) -> pa.Array:
        return pa.array([None if s is None else sound(s) for s in x.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(c)


# Consonants of the Indic blocks from their 0x15th place on, and vowels from the 5th; blocks share the layout.
INDIC_CONSONANTS = "k kh g gh n c ch j jh n t th d dh n t th d dh n n p ph b bh m y r r l l l v s s s h".split()
INDIC_VOWELS = "a a i i u u r l e e e ai o o o au".split()


def indic_word(word: str) -> str:
    """A word of an Indic script in Latin letters; a consonant has the vowel a unless a sign follows, the last has none."""
    out = []
    for c in word:
        at = (ord(c) - 0x900) % 0x80 if 0x900 <= ord(c) < 0xD80 else -1
        if 0x15 <= at <= 0x39:
            out.append(INDIC_CONSONANTS[at - 0x15] + "a")
        elif 0x05 <= at <= 0x14:
            out.append(INDIC_VOWELS[at - 0x05])
        elif 0x3E <= at <= 0x4C and out:
            out[-1] = out[-1].removesuffix("a") + INDIC_VOWELS[at - 0x3E + 1]
        elif at == 0x4D and out:
            out[-1] = out[-1].removesuffix("a")
        elif at == 0x02:
            out.append("n")
    text = "".join(out)
    return text[:-1] if len(text) > 3 and text.endswith("a") and text[-2] not in "aeiou" else text


def transliterate(c: Column, dictionary: dict[str, str] | None = None) -> Column:
    """Every Indic run by ``dictionary``, else by rule; other text as it is."""
    import re

    runs, known = re.compile("[ऀ-෿]+"), dict(dictionary or {})

    def run(x: pa.Array) -> pa.Array:
        return pa.array([None if s is None else runs.sub(lambda m: known.get(m[0]) or indic_word(m[0]), s) for s in x.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(c)
