"""Personal data: pattern spans, and information-theoretic sanitisation of the terms around them. DataFrame functions only.

Patterns find e-mail addresses, IP addresses, card and phone numbers. Each value found is a protected entity. A term within
REACH of it discloses it as far as their co-occurrence over the corpus says. All counts are of documents: n_e hold the
entity, n_t the term, n_et the term within REACH of the entity, N is all. With IC(e) = ln(N / n_e) and PMI(e, t) =
ln(N * n_et / (n_e * n_t)), the term gives away the share PMI / IC of the entity's information. Copies of one passage are
one piece of evidence, so the share is multiplied by the greater of (c + 1/2) / (c_e + 1), how regularly the term stands in
the entity's contexts, and c / (c + 1), how often it was seen there at all: c and c_e count the different contexts of the
pair and of the entity. From REMOVE on the term is removed, from GENERALISE on it is replaced by its shape. Terms are marked
only beside the entity that they disclose, so texts without entities stay as they are.

Defined cases: null text is empty (no spans); offsets are code points, end exclusive; added spans never overlap a base
span; an entity of every document has no information to give away; repeated rows count as documents and each get the same
spans; doc_id is whole numbers (others can't be cast); other columns are ignored, or kept by sanitise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.llm.common import hot_join, hot_keys, small, stage, table, text_key

KINDS = ("email", "ip", "card", "phone")
# Fixed values of the contract, written so that Java's matcher neither backtracks into a run nor recurses: possessive
# where what follows can't be inside, and a run begins where none is before it (or where the last match ended).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GUARDS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9][\x20().0-9-]"}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Code points on either side of an entity that are its context.
REACH = 240
REMOVE, GENERALISE = 0.9, 0.6
#: Code points of a text that are addressed together.
PAGE = 1024
#: Matches in a text whose places are summed up together.
MATCHES = 256
TERM = r"\p{L}{3,}"


def found(text: Column, pattern: str) -> Column:
    """array<struct<a, b, v>>: start, end and value of the leftmost non-overlapping matches, in code points."""
    whole = rf"\G((?s:.*?))({pattern})"
    parts = F.arrays_zip(F.regexp_extract_all(text, F.lit(whole), F.lit(1)).alias("g"), F.regexp_extract_all(text, F.lit(whole), F.lit(2)).alias("h"))
    none = F.expr("cast(array() as array<struct<a:int,b:int,v:string>>)")
    length = lambda x: F.length(x["g"]) + F.length(x["h"])

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["g"])
        b = a + F.length(x["h"])
        return F.struct(b.alias("at"), F.concat(acc["out"], F.array(F.struct(a.alias("a"), b.alias("b"), x["h"].alias("v")))).alias("out"))

    # a fold copies the array that it appends to, so it runs over blocks of matches, each from where the ones before end;
    # each step is bound once, as an expression that is named in a lambda is computed for each of its elements
    def blocks(p: Column) -> Column:
        ends = F.sequence(F.lit(0), F.floor((F.size(p) - 1) / MATCHES).cast("int"))
        return F.transform(ends, lambda i: F.slice(p, i * MATCHES + 1, F.lit(MATCHES)))

    def placed(b: Column) -> Column:
        totals = F.transform(b, lambda block: F.aggregate(block, F.lit(0), lambda n, x: n + length(x)))
        starts = F.aggregate(totals, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        return F.zip_with(b, F.slice(starts, F.lit(1), F.size(b)), lambda block, at: F.aggregate(block, F.struct(at.alias("at"), none.alias("out")), step)["out"])

    return once(parts, lambda p: F.when(F.size(p) > 0, F.flatten(once(blocks(p), placed))).otherwise(none))


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(v: Column) -> Column:
    """Whether 13 to 19 digits pass the checksum: from the right, every second is doubled and its digits are summed."""
    d = F.reverse(digits(v))

    def step(acc: Column, i: Column) -> Column:
        x = F.try_to_number(F.substring(d, i, F.lit(1)), F.lit("9")).cast("int") * (F.lit(2) - i % 2)
        return acc + F.when(x > 9, x - 9).otherwise(x)

    total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), step)
    return F.when(F.length(d).between(13, 19), total % 10 == 0).otherwise(False)


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike("^" + r"\.".join([OCTET] * 4) + "$"),
    "card": luhn,
    "phone": lambda v: F.length(digits(v)).between(9, 15),
}


def base_spans(docs: DataFrame) -> DataFrame:
    """docs (with text, not null) and _base: array<struct<kind int, a, b, v>> by kind, then start."""
    none = F.expr("cast(array() as array<struct<a:int,b:int,v:string>>)")
    for k in KINDS:
        docs = docs.withColumn(f"_{k}", F.when(F.col("text").rlike(GUARDS[k]), found(F.col("text"), PATTERNS[k])).otherwise(none))

    def valid(i: int, k: str) -> Column:
        passed = F.filter(f"_{k}", lambda x: VALID[k](x["v"]))
        return F.transform(passed, lambda x: F.struct(F.lit(i).alias("kind"), x["a"].alias("a"), x["b"].alias("b"), x["v"].alias("v")))

    return docs.withColumn("_base", F.concat(*(valid(i, k) for i, k in enumerate(KINDS)))).drop(*(f"_{k}" for k in KINDS))


def once(x: Column, f) -> Column:
    """f(x), where x is computed once however often f names it: an expression inside a lambda is computed for each element."""
    return F.element_at(F.transform(F.array(x), f), 1)


def pages(text: Column) -> Column:
    """A text in pieces of PAGE code points, so that a piece of it is found without a walk from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0))


def cut(paged: Column, a: Column, b: Column) -> Column:
    """The code points from a to b, end exclusive, of a text in pages."""
    first = F.floor(a / PAGE).cast("int")
    some = F.array_join(F.slice(paged, first + 1, F.floor(b / PAGE).cast("int") - first + 1), "")
    return F.when(b > a, F.substring(some, a - first * PAGE + 1, b - a)).otherwise("")


def covered(text: Column, spans: Column) -> Column:
    """The text with a 0 for each code point of the spans, which are in order and don't overlap."""
    end = lambda j: F.coalesce(F.get(spans, j)["b"], F.lit(0))

    def joined(p: Column) -> Column:
        pieces = F.transform(spans, lambda x, j: F.concat(cut(p, end(j - 1), x["a"]), F.repeat(F.lit("0"), x["b"] - x["a"])))
        return F.concat(F.array_join(pieces, ""), cut(p, end(F.size(spans) - 1), F.size(p) * PAGE))

    return F.when(F.size(spans) == 0, text).otherwise(once(pages(text), joined))


def masked(text: Column, base: Column) -> Column:
    """The text with its base spans covered, kind by kind, as only spans of unlike kinds overlap."""

    def one_kind(text: Column, kind: int) -> Column:
        return once(text, lambda t: once(F.filter(base, lambda x: x["kind"] == kind), lambda spans: covered(t, spans)))

    for kind in range(len(KINDS)):
        text = one_kind(text, kind)
    return text


def contexts(text: Column, base: Column) -> Column:
    """array<struct<entity, place, terms array<struct<term, a, b>>>>: for each base span its entity, the hash of its context, and the terms there.

    Words that REACH cuts are left out, and so is all that is part of a base span.
    """

    def around(p: Column, x: Column) -> Column:
        start = F.greatest(x["a"] - REACH, F.lit(0))
        left, right = cut(p, start, x["a"]), cut(p, x["b"], x["b"] + REACH)
        words = lambda of, at: F.transform(found(of, TERM), lambda y: F.struct(F.lower(y["v"]).alias("term"), (y["a"] + at).alias("a"), (y["b"] + at).alias("b")))
        before = F.filter(words(left, start), lambda y: (y["a"] > start) | (start == 0))
        after = F.filter(words(right, x["b"]), lambda y: (y["b"] < x["b"] + REACH))
        return F.struct(F.concat_ws(":", x["kind"].cast("string"), x["v"]).alias("entity"), F.xxhash64(left, right).alias("place"), F.concat(before, after).alias("terms"))

    return once(pages(masked(text, base)), lambda p: F.transform(base, lambda x: around(p, x)))


def of_pair(entity: Column, term: Column) -> Column:
    """A term beside an entity, as one string; neither holds a line feed."""
    return F.concat_ws("\n", entity, term)


def disclosed(around: DataFrame, docs: DataFrame) -> DataFrame:
    """pair, n, share: terms that give away GENERALISE or more of an entity, and the number of documents of the pair. around: one row for each document with entities."""
    entity, pairs = F.col("x.entity"), F.transform("x.terms", lambda t: of_pair(F.col("x.entity"), t["term"]))
    places = around.select(F.explode("around").alias("x"))
    distinct = lambda df, key: df.distinct().groupBy(key).agg(F.count("*").alias("c"))
    of_entities = distinct(places.select(entity.alias("entity"), "x.place"), "entity").withColumnRenamed("c", "c_e")
    of_pairs = distinct(places.select(F.explode(F.array_distinct(pairs)).alias("pair"), "x.place"), "pair")
    in_docs = lambda strings, name, n: around.select(F.explode(F.array_distinct(strings)).alias(name)).groupBy(name).agg(F.count("*").alias(n))
    entities = in_docs(F.transform("around", lambda x: x["entity"]), "entity", "n_e").join(of_entities, "entity")
    pairs = in_docs(F.flatten(F.transform("around", lambda x: F.transform(x["terms"], lambda t: of_pair(x["entity"], t["term"])))), "pair", "n_et").join(of_pairs, "pair")
    evidence = F.greatest((F.col("c") + 0.5) / (F.col("c_e") + 1), F.col("c") / (F.col("c") + 1))
    pairs = pairs.withColumn("entity", F.substring_index("pair", "\n", 1)).join(entities, "entity").withColumn("evidence", evidence).where(F.col("evidence") >= GENERALISE)
    pairs = stage(pairs.select("pair", F.substring_index("pair", "\n", -1).alias("term"), "n_et", "n_e", "evidence"), "pii-pairs")
    terms = stage(pairs.select("term").distinct(), "pii-terms")
    size = terms.agg(F.sum(F.octet_length("term") + 48)).first()[0] or 0
    words = docs.select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), lambda w: F.lower(w)))).alias("term"))
    known = words.join(small(terms, size), "term", "left_semi") if size else words.where("false")
    known = stage(known.groupBy("term").agg(F.count("*").alias("n_t")), "pii-known")
    n = docs.count()
    share = F.log(F.col("n_et") * F.lit(float(n)) / (F.col("n_e") * F.col("n_t"))) / F.log(F.lit(float(n)) / F.col("n_e")) * F.col("evidence")
    share = F.round(share, 9)  # the last digits of a logarithm decide nothing
    counts = known.agg(F.sum(F.octet_length("term") + 48)).first()[0] or 0
    said = pairs.where(F.col("n_e") < n).join(small(known, counts), "term").select("pair", F.col("n_et").alias("n"), share.alias("share"))
    return stage(said.where(F.col("share") >= GENERALISE), "pii-disclosed")


def found_spans(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: key, doc_id, base and added spans (array<struct<kind, a, b>>, array<struct<a, b, share>>)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    based = base_spans(docs.withColumn("key", text_key()))
    around = F.when(F.size("_base") > 0, contexts(F.col("text"), F.col("_base")))
    plain = F.transform("_base", lambda x: F.struct(x["kind"].alias("kind"), x["a"].alias("a"), x["b"].alias("b")))
    rows = stage(based.select("doc_id", "key", plain.alias("base"), around.alias("around")), "pii-base")
    some = rows.where("around is not null").select("key", "around")
    said = disclosed(some, docs)
    total, size = said.agg(F.sum("n"), F.sum(F.octet_length("pair") + 64)).first()
    near = some.select("key", F.explode("around").alias("x")).select("key", "x.entity", F.explode("x.terms").alias("t"))
    near = near.select("key", "t.a", "t.b", of_pair(F.col("entity"), F.col("t.term")).alias("pair"))
    said = small(said, size or 0)
    hot = hot_keys(said.select("pair", "n"), "pair", total or 0)
    marked = hot_join(near, said.drop("n"), "pair", "key", hot)
    added = marked.groupBy("key", "a", "b").agg(F.max("share").alias("share")).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("a", "b", "share"))).alias("added"))
    return rows.select("doc_id", "key", "base").join(added, "key", "left").select("doc_id", "key", "base", F.coalesce("added", F.expr("cast(array() as array<struct<a:int,b:int,share:double>>)")).alias("added"))


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with entities replaced by their kind in brackets, disclosing terms by [TERM] or, less telling, by their shape."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    columns = docs.columns
    kept = docs.withColumn("_pii_key", text_key())
    spans = found_spans(docs).dropDuplicates(["key"]).where((F.size("base") > 0) | (F.size("added") > 0))
    out = kept.join(spans.select(F.col("key").alias("_pii_key"), F.col("base").alias("_pii_base"), F.col("added").alias("_pii_added")), "_pii_key", "left")
    shape = lambda x: F.regexp_replace(F.regexp_replace(F.substring("text", x["a"] + 1, x["b"] - x["a"]), r"\p{Lu}", "X"), r"[^X]", "x")
    edits = F.sort_array(F.concat(
        F.transform("_pii_base", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), F.element_at(names, x["kind"] + 1).alias("by"))),
        F.transform("_pii_added", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), F.when(x["share"] >= REMOVE, F.lit("[TERM]")).otherwise(shape(x)).alias("by"))),
    ))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, x: F.when(x["a"] < acc["at"], acc).otherwise(F.struct(x["b"].alias("at"), F.concat(acc["out"], F.substring("text", acc["at"] + 1, x["a"] - acc["at"]), x["by"]).alias("out")))
    done = F.aggregate(edits, start, step)
    edited = F.concat(done["out"], F.substring("text", done["at"] + 1, F.length("text")))
    return out.withColumn("text", F.when(F.col("_pii_base").isNotNull(), edited).otherwise(F.col("text"))).select(columns)


def op1_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = found_spans(table(spark, sf_dir, "documents"))
    kinds = F.array(*map(F.lit, KINDS))
    spelled = lambda name, x: F.concat(name, F.lit(":"), x["a"].cast("string"), F.lit(":"), x["b"].cast("string"))
    base = F.transform("base", lambda x: spelled(F.element_at(kinds, x["kind"] + 1), x))
    added = F.transform("added", lambda x: spelled(F.when(x["share"] >= REMOVE, F.lit("removed")).otherwise(F.lit("generalised")), x))
    count = lambda i: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long")
    return spans.select("doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)), F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, added), ",").alias("spans"))


def _placed_sql(text: str, pattern: str) -> str:
    """A list of {a, b, v} in DuckDB: the matches of a pattern, placed by the lengths of what is between them."""
    m, g = f"regexp_extract_all({text}, '{pattern}')", f"list_transform(string_split_regex({text}, '{pattern}'), lambda x: length(x))"
    return f"""list_transform([{{'m': {m}, 'g': {g}, 'n': list_transform({m}, lambda x: length(x))}}], lambda z: list_transform(range(1, len(z.m) + 1), lambda i:
        {{'a': CAST(list_sum(z.g[1:i]) + coalesce(list_sum(z.n[1:i - 1]), 0) AS BIGINT), 'b': CAST(list_sum(z.g[1:i]) + list_sum(z.n[1:i]) AS BIGINT), 'v': z.m[i]}}))[1]"""


_DIGITS_SQL = "regexp_replace(x.v, '[^0-9]', '', 'g')"
#: Each kind's pattern, as the contract has it, and what a match must be.
_KINDS_SQL = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(x.v, '.'), lambda y: coalesce(TRY_CAST(y AS HUGEINT), 256) > 255)) = 0"),
    (r"[0-9]([\x20-]?[0-9])+", f"""length({_DIGITS_SQL}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS_SQL}) + 1), lambda i:
        [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 0, 2, 4, 6, 8, 1, 3, 5, 7, 9][10 * ((i - 1) % 2) + CAST(substr({_DIGITS_SQL}, -i, 1) AS INT) + 1])) % 10 = 0"""),
    (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS_SQL}) BETWEEN 9 AND 15"),
)
_BASE_SQL = " || ".join(f"list_transform(list_filter({_placed_sql('text', p)}, lambda x: {ok}), lambda x: {{'k': {k}, 'a': x.a, 'b': x.b, 'v': x.v}})" for k, (p, ok) in enumerate(_KINDS_SQL))
_TERM_SQL = r"\p{L}{3,}"


def _masked_sql(since: str, until: str) -> str:
    part = f"substr(text, {since} + 1, {until} - {since})"
    return f"array_to_string(list_transform(range(1, length({part}) + 1), lambda i: CASE WHEN len(list_filter(base, lambda y: y.a < {since} + i AND {since} + i <= y.b)) > 0 THEN '0' ELSE substr({part}, i, 1) END), '')"


#: The same by loops over lists: contexts cut from the text, every count made over all documents.
OP1_SQL = f"""WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), s AS (
    SELECT r, doc_id, text, {_BASE_SQL} AS base FROM d
), e AS (
    SELECT r, text, base, unnest(base) AS x FROM s
), w AS (
    SELECT r, x.k || ':' || x.v AS entity, greatest(x.a - {REACH}, 0) AS since, x.b AS b,
        {_masked_sql(f"greatest(x.a - {REACH}, 0)", "x.a")} AS before, {_masked_sql("x.b", f"(x.b + {REACH})")} AS after FROM e
), t AS (
    SELECT r, entity, before || chr(10) || chr(0) || after AS place, unnest(
        list_transform(list_filter({_placed_sql("before", _TERM_SQL)}, lambda y: y.a > 0 OR since = 0), lambda y: {{'term': lower(y.v), 'a': y.a + since, 'b': y.b + since}})
        || list_transform(list_filter({_placed_sql("after", _TERM_SQL)}, lambda y: y.b < {REACH}), lambda y: {{'term': lower(y.v), 'a': y.a + b, 'b': y.b + b}})) AS y FROM w
), ne AS (
    SELECT entity, count(DISTINCT r) AS n_e, count(DISTINCT before || chr(10) || chr(0) || after) AS c_e FROM w GROUP BY entity
), net AS (
    SELECT entity, y.term AS term, count(DISTINCT r) AS n_et, count(DISTINCT place) AS c FROM t GROUP BY ALL
), nt AS (
    SELECT term, count(*) AS n_t FROM (SELECT unnest(list_distinct(list_transform(regexp_extract_all(text, '{_TERM_SQL}'), lambda x: lower(x)))) AS term FROM d) GROUP BY term
), said AS (
    SELECT entity, term, round(ln(n_et * n / (n_e * n_t)) / ln(n / n_e) * greatest((c + 0.5::DOUBLE) / (c_e + 1), c / (c + 1)), 9) AS share
    FROM net JOIN ne USING (entity) JOIN nt USING (term), (SELECT CAST(count(*) AS DOUBLE) AS n FROM d) WHERE n_e < n
), added AS (
    SELECT r, list(CASE WHEN share >= {REMOVE} THEN 'removed:' ELSE 'generalised:' END || a || ':' || b ORDER BY a, b) AS added
    FROM (SELECT r, y.a AS a, y.b AS b, max(share) AS share FROM t JOIN said ON said.entity = t.entity AND said.term = t.y.term WHERE share >= {GENERALISE} GROUP BY ALL) GROUP BY r
), z AS (
    SELECT r, doc_id, base, list_transform(base, lambda x: ['email', 'ip', 'card', 'phone'][x.k + 1] || ':' || x.a || ':' || x.b) AS said FROM s
)
SELECT doc_id, {", ".join(f"CAST(len(list_filter(base, lambda x: x.k = {i})) AS BIGINT) AS n_{k}" for i, k in enumerate(KINDS))},
    sha256(array_to_string(said, ',')) AS base_sha256, array_to_string(said || coalesce(added, []), ',') AS spans FROM z LEFT JOIN added USING (r)"""
