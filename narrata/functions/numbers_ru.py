"""Numbers as Russian words: cardinals, ordinals in every case, and the noun form after a number.

Each rule exists twice, from the same tables: as a Spark column and as SQL text for the result checks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words of Russian numerals.
UNITS = ["", "один", "два", "три", "четыре", "пять", "шесть", "семь", "восемь", "девять", "десять", "одиннадцать", "двенадцать", "тринадцать", "четырнадцать", "пятнадцать", "шестнадцать", "семнадцать", "восемнадцать", "девятнадцать"]
FEMININE = ["", "одна", "две", *UNITS[3:]]
TENS = ["", "", "двадцать", "тридцать", "сорок", "пятьдесят", "шестьдесят", "семьдесят", "восемьдесят", "девяносто"]
HUNDREDS = ["", "сто", "двести", "триста", "четыреста", "пятьсот", "шестьсот", "семьсот", "восемьсот", "девятьсот"]
ORDINAL_UNITS = ["нулевой", "первый", "второй", "третий", "четвёртый", "пятый", "шестой", "седьмой", "восьмой", "девятый", "десятый", "одиннадцатый", "двенадцатый", "тринадцатый", "четырнадцатый", "пятнадцатый", "шестнадцатый", "семнадцатый", "восемнадцатый", "девятнадцатый"]
ORDINAL_TENS = ["", "", "двадцатый", "тридцатый", "сороковой", "пятидесятый", "шестидесятый", "семидесятый", "восьмидесятый", "девяностый"]
ORDINAL_HUNDREDS = ["", "сотый", "двухсотый", "трёхсотый", "четырёхсотый", "пятисотый", "шестисотый", "семисотый", "восьмисотый", "девятисотый"]
# What stands before "тысячный" and larger.
FUSED_UNITS = ["", "одно", "двух", "трёх", "четырёх", "пяти", "шести", "семи", "восьми", "девяти", "десяти", "одиннадцати", "двенадцати", "тринадцати", "четырнадцати", "пятнадцати", "шестнадцати", "семнадцати", "восемнадцати", "девятнадцати"]
FUSED_TENS = ["", "", "двадцати", "тридцати", "сорока", "пятидесяти", "шестидесяти", "семидесяти", "восьмидесяти", "девяносто"]
FUSED_HUNDREDS = ["", "сто", "двухсот", "трёхсот", "четырёхсот", "пятисот", "шестисот", "семисот", "восьмисот", "девятисот"]
SCALES = [(10**12, ("триллион", "триллиона", "триллионов"), "триллионный"), (10**9, ("миллиард", "миллиарда", "миллиардов"), "миллиардный"), (10**6, ("миллион", "миллиона", "миллионов"), "миллионный"), (10**3, ("тысяча", "тысячи", "тысяч"), "тысячный")]
LIMIT = 10**15
SHORT = {"ый": "й", "ий": "й", "ая": "я", "ое": "е", "ее": "е"}
ENDINGS = {"го": "ого", "ого": "ого", "му": "ому", "ому": "ому", "м": "ом", "х": "ых", "я": "ая", "е": "ое", "ю": "ую", "ой": "ой", "ую": "ую", "ым": "ым", "ых": "ых", "ые": "ые"}
THIRD = {"го": "третьего", "ого": "третьего", "му": "третьему", "ому": "третьему", "м": "третьем", "х": "третьих", "я": "третья", "е": "третье", "ю": "третью", "ой": "третьей", "ую": "третью", "ым": "третьим", "ых": "третьих", "ые": "третьи"}
MONTHS = ["января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря"]
FRACTIONS = {1: "десятых", 2: "сотых", 3: "тысячных", 4: "десятитысячных"}




def _below_thousand(units: list[str], tens: list[str], hundreds: list[str], between: str) -> list[str]:
    """The words of 0 to 999."""
    small = lambda n: [units[n]] if n < 20 else [tens[n // 10], units[n % 10]]
    return [between.join(filter(None, [hundreds[n // 100], *small(n % 100)])) for n in range(1000)]


def _ordinals() -> list[str]:
    """The ordinals of 0 to 999: all words but the last are cardinals."""
    out = []
    for n in range(1000):
        last = next((m for m in (n % 100 if n % 100 < 20 else n % 10, n % 100, n) if m), 0)
        word = ORDINAL_UNITS[last] if last < 20 else ORDINAL_TENS[last // 10] if last < 100 else ORDINAL_HUNDREDS[last // 100]
        out.append(" ".join(filter(None, [WORDS["m"][n - last] if n > last else "", word])))
    return out


#: By gender (m, f), as the fused first part of "тысячный" (z), and as ordinals (o).
WORDS = {"m": _below_thousand(UNITS, TENS, HUNDREDS, " "), "f": _below_thousand(FEMININE, TENS, HUNDREDS, " "), "z": _below_thousand(FUSED_UNITS, FUSED_TENS, FUSED_HUNDREDS, "")}
WORDS["o"] = _ordinals()
_quoted = lambda s: "'" + s.replace("'", "''") + "'"
#: A common table expression with the word lists, for the SQL forms below; they need it in scope as w.
WORDS_SQL = "w AS (SELECT " + ", ".join(f"[{', '.join(map(_quoted, v))}] AS {k}" for k, v in WORDS.items()) + ")"


class Sql:
    """The operations that the rules need, as SQL text."""

    lit = staticmethod(_quoted)
    div = staticmethod(lambda a, n: f"(({a}) // {n})")
    mod = staticmethod(lambda a, n: f"(({a}) % {n})")
    minus = staticmethod(lambda a, k, n: f"(({a}) - ({k}) * {n})")
    lt = staticmethod(lambda a, n: f"(({a}) < {n})")
    eq = staticmethod(lambda a, n: f"(({a}) = {n})")
    ne = staticmethod(lambda a, n: f"(({a}) <> {n})")
    both = staticmethod(lambda a, b: f"({a} AND {b})")
    between = staticmethod(lambda a, lo, hi: f"(({a}) BETWEEN {lo} AND {hi})")
    outside = staticmethod(lambda a, lo, hi: f"(({a}) NOT BETWEEN {lo} AND {hi})")
    text = staticmethod(lambda a: f"CAST(({a}) AS VARCHAR)")
    cat = staticmethod(lambda *xs: "(" + " || ".join(xs) + ")")
    pick = staticmethod(lambda k, i: f"w.{k}[({i}) + 1]")
    replace = staticmethod(lambda x, p, by: f"regexp_replace({x}, '{p}', '{by}')")
    ends = staticmethod(lambda x, s: f"({x} LIKE '%{s}')")
    _names = 0

    @staticmethod
    def let(x: str, f) -> str:
        """f of a value that is computed once."""
        Sql._names += 1
        v = f"v{Sql._names}"
        return f"list_transform([{x}], lambda {v}: {f(v)})[1]"

    @staticmethod
    def when(*cases, other: str) -> str:
        return "(CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in cases) + f" ELSE {other} END)"

    @staticmethod
    def join(*parts: str) -> str:
        return f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x <> ''), ' ')"


class Col:
    """The same operations as columns."""

    lit = staticmethod(F.lit)
    div = staticmethod(lambda a, n: F.floor(a / n).cast("long"))
    mod = staticmethod(lambda a, n: a % n)
    minus = staticmethod(lambda a, k, n: a - k * n)
    lt = staticmethod(lambda a, n: a < n)
    eq = staticmethod(lambda a, n: a == n)
    ne = staticmethod(lambda a, n: a != n)
    both = staticmethod(lambda a, b: a & b)
    between = staticmethod(lambda a, lo, hi: a.between(lo, hi))
    outside = staticmethod(lambda a, lo, hi: ~a.between(lo, hi))
    text = staticmethod(lambda a: a.cast("string"))
    cat = staticmethod(lambda *xs: F.concat(*xs))
    pick = staticmethod(lambda k, i: F.element_at(F.lit(WORDS[k]), i.cast("int") + 1))
    replace = staticmethod(F.regexp_replace)
    ends = staticmethod(lambda x, s: x.endswith(s))
    let = staticmethod(lambda x, f: F.element_at(F.transform(F.array(x), lambda v: f(v)), 1))

    @staticmethod
    def when(*cases, other: Column) -> Column:
        (c, v), *rest = cases
        out = F.when(c, v)
        for c, v in rest:
            out = out.when(c, v)
        return out.otherwise(other)

    @staticmethod
    def join(*parts: Column) -> Column:
        return F.array_join(F.filter(F.array(*parts), lambda x: x != ""), " ")


def unit_form(n, one: str, few: str, many: str, o=Col):
    """The noun after a whole number."""
    ten, hundred = o.mod(n, 10), o.mod(n, 100)
    return o.when((o.both(o.eq(ten, 1), o.ne(hundred, 11)), o.lit(one)), (o.both(o.between(ten, 2, 4), o.outside(hundred, 12, 14)), o.lit(few)), other=o.lit(many))


def cardinal(n, o=Col):
    """0 to LIMIT - 1 in words; larger numbers stay digits. n should be a column or a literal, as it is named often."""
    parts = []
    for scale, nouns, _ in SCALES:
        k = o.mod(o.div(n, scale), 1000)
        parts += [o.pick("f" if scale == 1000 else "m", k), o.when((o.eq(k, 0), o.lit("")), other=unit_form(k, *nouns, o=o))]
    return o.when((o.eq(n, 0), o.lit("ноль")), (o.lt(n, LIMIT), o.join(*parts, o.pick("m", o.mod(n, 1000)))), other=o.text(n))


def ordinal(n, o=Col):
    """The masculine nominative; only the last word is an ordinal, and "тысяча" stands for "одна тысяча" before it."""
    rest = o.mod(n, 1000)
    cases = [(o.ne(rest, 0), o.minus(n, rest, 1))]
    words = [(o.ne(rest, 0), o.pick("o", rest)), (o.eq(n, 0), o.pick("o", rest))]
    for scale, _, word in reversed(SCALES):
        k = o.mod(o.div(n, scale), 1000)
        cases.append((o.ne(k, 0), o.minus(n, k, scale)))
        words.append((o.ne(k, 0), o.when((o.eq(k, 1), o.lit(word)), other=o.cat(o.pick("z", k), o.lit(word)))))
    before = o.let(o.when(*cases, other=n), lambda a: o.when((o.eq(a, 0), o.lit("")), other=o.replace(cardinal(a, o), "^одна тысяча", "тысяча")))
    return o.when((o.lt(n, LIMIT), o.join(o.when((o.eq(n, 0), o.lit("")), other=before), o.when(*words, other=o.lit("")))), other=o.text(n))


def inflected(base, suffix: str, o=Col):
    """An ordinal's other forms, by the ending that books write after the digits."""
    suffix = SHORT.get(suffix, suffix)
    if suffix == "й":
        return base
    return o.let(base, lambda b: o.when((o.ends(b, "третий"), o.replace(b, "третий$", THIRD[suffix])), other=o.replace(b, "(ый|ой)$", ENDINGS[suffix])))
