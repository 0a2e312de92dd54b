"""Operator 1: information-theoretic sanitisation of personal data.

Protected are *concepts*: each value that patterns find (values that stand in the
very same documents are one concept), each kind of value, and secrets. With counts
of documents, PMI(c; t) = log(N n(c,t) / (n(c) n(t))) says how strongly a term
reveals a concept. A term is disclosive if that is at least ALPHA of the concept's
information log(N / n(c)) and chance does not explain it: the Chernoff bound of
the binomial tail for the rarer one of both, exp(-m KL(n(c,t)/m || q/N)) with
m = min(n(c), n(t)) and q the other count, is at most LEVEL; for kinds, which meet
every term, LEVEL over the number of terms judged. A disclosive term is generalised
to its class (a number, a name, a word) wherever it stands in a document of the
concept; where the class discloses too, it is removed.

A secret is an opaque string (SECRET characters or more, letters and digits) whose
context discloses it: the word before it is a term, secrets are the concept, and
the joint count is that of documents where the word stands before such a string.

All of it is column expressions, group-wise sums and equi-joins. A document's pairs
of concept and term are made only where the counts leave them a chance:
n(t) <= n(c)^ALPHA N^(1-ALPHA) follows from the first condition.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small, table

KINDS = ["email", "ip", "card", "phone"]
#: What each kind looks like. Quantifiers are possessive where no
#: way back could match, so time is linear in the text; a match starts where a
#: run of its characters or the search itself starts.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM, BETWEEN = r"[\p{L}\p{N}]{3,}", r"[^\p{L}\p{N}]+"
#: Characters from which an opaque string may be a secret: 64 bits at 4 bits each.
SECRET = 16
OPAQUE = rf"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9][A-Za-z0-9+/_=-]{{{SECRET - 1}}})(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]++"
#: Opaque strings with no word between them: they have one context.
OPAQUES = rf"{OPAQUE}(?:[^\p{{L}}\p{{N}}]*+{OPAQUE})*+"
LAST_WORD = r"(?<![\p{L}\p{N}])([\p{L}\p{N}]++)[^\p{L}\p{N}]*+$"
ALPHA, LEVEL = 0.8, 0.05
CLASSES = {"number": r"\p{N}", "name": r"\p{Lu}", "word": r"\p{L}"}
_SPAN, _MATCH = "struct<s:int,e:int,v:string>", "struct<s:int,e:int,v:string,gap:string>"
_SECRET = "struct<s:int,e:int,v:string,c:bigint>"


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _before(values: Column, zero: Column, op: Callable[[Column, Column], Column], use: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """What ``use`` makes of a function from a place (from 0) to the fold of all values
    before it. Folds of blocks of 64 and of blocks of those are made first: an array
    can't grow in a fold, which copies its state at each step."""
    fold = lambda a: F.aggregate(a, zero, op)
    blocks = lambda a: F.transform(_places(F.shiftright(F.size(a) + 63, 6)), lambda b: fold(F.slice(a, b * 64 + 1, F.lit(64))))

    def place(v: Column, b: Column, s: Column) -> Callable[[Column], Column]:
        high = lambda i: fold(F.slice(s, F.lit(1), F.shiftright(i, 12)))
        mid = lambda i: fold(F.slice(b, F.shiftright(i, 12) * 64 + 1, F.shiftright(i, 6) % 64))
        return lambda i: op(op(high(i), mid(i)), fold(F.slice(v, F.shiftright(i, 6) * 64 + 1, i % 64)))

    return _let(values, lambda v: _let(blocks(v), lambda b: _let(blocks(b), lambda s: use(place(v, b, s)))))


def _places(n: Column) -> Column:
    """0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(_none("int"))


def matches(text: Column, pattern: str, good: Callable[[Column], Column] | None = None) -> Column:
    """Start, end (code points), string and the text since the match before, of the
    leftmost matches that don't overlap, less those that are not good."""

    def of(found: Column, gaps: Column) -> Column:
        all_places = _places(F.size(found))
        wanted = F.filter(all_places, lambda i: good(F.get(found, i))) if good else all_places

        def span(i: Column, before: Callable[[Column], Column]) -> Column:
            return _let(before(i) + F.length(F.get(gaps, i)), lambda s: F.struct(s.alias("s"), (s + F.length(F.get(found, i))).alias("e"), F.get(found, i).alias("v"), F.get(gaps, i).alias("gap")))

        sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, v: F.length(g) + F.length(v))
        return _let(wanted, lambda w: F.when(F.size(w) > 0, _before(sizes, F.lit(0), lambda x, y: x + y, lambda before: F.transform(w, lambda i: span(i, before)))).otherwise(_none(_MATCH)))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: _let(F.split(text, pattern, -1), lambda gaps: of(found, gaps)))


def _blank(text: Column, pattern: str, good: Callable[[Column], Column] | None = None) -> Column:
    """The text with spaces in place of good matches; no character changes its place."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    blank = lambda v: F.repeat(F.lit(" "), F.length(v))
    said = F.transform(found, lambda v: F.when(good(v), blank(v)).otherwise(v) if good else blank(v))
    pairs = F.zip_with(F.split(text, pattern, -1), said, lambda g, v: F.concat(g, F.coalesce(v, F.lit(""))))
    return F.array_join(pairs, "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def worth(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + worth(i)) % 10 == 0


def _holds(kind: str) -> Callable[[Column], Column]:
    def good(v: Column) -> Column:
        digits = F.regexp_replace(v, "[^0-9]", "")
        if kind == "ip":
            return ~F.exists(F.split(v, r"\."), lambda p: ~F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
        if kind == "card":  # short numbers, the most of them, go by their length alone
            return F.when(F.length(v) < 16, False).when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
        if kind == "phone":
            return F.length(digits).between(8, 15)
        return F.lit(True)

    return good


def base_spans(text: Column) -> Column:
    """All base spans by kind as listed, then start: k (number of the kind), s, e, v."""
    needs = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "ip": text.rlike("[0-9]\\.[0-9]"), "card": text.rlike(PATTERNS["card"].replace("++", "{15}"))}

    def of(k: int, kind: str) -> Column:
        spans = F.transform(matches(text, PATTERNS[kind], _holds(kind)), lambda x: F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v")))
        return F.when(needs[kind], spans).otherwise(_none("struct<k:int,s:int,e:int,v:string>"))

    return F.concat(*[of(k, kind) for k, kind in enumerate(KINDS)])


def _freed(rows: DataFrame) -> DataFrame:
    """Adds free: the text with blanks for its base spans, kind by kind."""
    rows = rows.withColumn("free", F.col("text"))
    for k, kind in enumerate(KINDS):
        here = F.array_contains("spans.k", k)
        rows = rows.withColumn("free", F.when(here, _blank(F.col("free"), PATTERNS[kind], _holds(kind))).otherwise(F.col("free")))
    return rows


def _candidates(text: Column) -> Column:
    """Opaque strings: s, e, v, c (hash of the last word before it that is none itself;
    null if there is none)."""

    def of(run: Column) -> Column:
        word = F.nullif(F.regexp_extract(run["gap"], LAST_WORD, 1), F.lit(""))
        c = F.when(word.isNotNull(), F.xxhash64(F.lower(word)))
        return F.transform(matches(run["v"], OPAQUE), lambda x: F.struct((run["s"] + x["s"]).alias("s"), (run["s"] + x["e"]).alias("e"), x["v"].alias("v"), c.alias("c")))

    return F.when(text.rlike(OPAQUE), F.flatten(F.transform(matches(text, OPAQUES), of))).otherwise(_none(_SECRET))


def _words(text: Column) -> Column:
    """Hashes of the different terms of a text."""
    long = F.filter(F.split(text, BETWEEN), lambda w: F.length(w) >= 3)
    return F.transform(F.array_distinct(F.transform(long, lambda w: F.lower(w))), lambda w: F.xxhash64(w))


def _class_of(v: Column) -> Column:
    return F.when(v.rlike("^" + CLASSES["number"]), "number").when(v.rlike("^" + CLASSES["name"]), "name").otherwise("word")


def _share(n: float, joint: Column, a: Column, b: Column) -> Column:
    """PMI over the information of what stands in ``a`` documents."""
    return F.log(F.lit(n) * joint / (a * b)) / F.log(F.lit(n) / a)


def _surprise(n: float, joint: Column, a: Column, b: Column) -> Column:
    """-log of the Chernoff bound; 0 if the joint count is no more than chance expects."""
    m, q = F.least(a, b), F.greatest(a, b) / F.lit(n)
    p = F.least(joint / m, F.lit(1.0))
    rest = F.when((p < 1) & (q < 1), (1 - p) * F.log((1 - p) / (1 - q))).otherwise(0.0)
    return F.when(p > q, m * (p * F.log(p / q) + rest)).otherwise(0.0)


def _concepts(marked: DataFrame) -> DataFrame:
    """key, rows (of this key), concept, n_c (documents of it), general (a kind) of each
    document's concepts."""
    each = marked.where(F.size("spans") > 0)
    values = F.array_distinct(F.transform("spans", lambda x: F.xxhash64(x["k"], F.lower(x["v"]))))
    held = each.select("key", F.explode(values).alias("value"))
    # Values with the same documents have the same count with every term: one concept.
    same = F.xxhash64(F.count("*"), F.sum(F.shiftright("key.a", 24)), F.bit_xor(F.xxhash64("key")), F.max("key"))
    sets = cut(held.groupBy("value").agg(same.alias("concept"), F.count("*").alias("n_c")))
    of = held.join(small(sets), "value").select("key", "concept", "n_c", F.lit(False).alias("general")).distinct()
    kinds = each.select("key", F.explode(F.array_distinct("spans.k")).alias("k")).select("key", F.xxhash64(F.lit("kind"), "k").alias("concept"))
    many = cut(kinds.groupBy("concept").agg(F.count("*").alias("n_c")))
    out = of.unionByName(kinds.join(F.broadcast(many), "concept").select("key", "concept", "n_c", F.lit(True).alias("general")).distinct())
    rows = cut(each.groupBy("key").agg(F.count("*").alias("rows")))
    return out.join(small(rows), "key")


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, level: float = LEVEL, with_text: bool = True) -> DataFrame:
    """doc_id, text_hash, text, spans (base: k, s, e, v), secrets (s, e, v) and terms
    (disclosive ones: s, e, v, class, general) of each row of ``docs``, in order.

    A null text is empty. A null id is a document like any other. Repeated rows stay
    repeated and count as documents in the corpus statistics, as copies do. Ties don't
    matter: all is decided by counts. No entities, or an empty table, give no terms.
    Other columns are ignored. ``with_text=False`` leaves the text out, and its join."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    base = base.withColumn("key", F.struct(F.xxhash64("doc_id", "text_hash").alias("a"), F.col("text_hash").alias("b")))
    found = base.select("key", "doc_id", "text_hash", "text", base_spans(F.col("text")).alias("spans"))
    found = _freed(found).select("key", "doc_id", "text_hash", "spans", "free", _candidates(F.col("free")).alias("opaque"))
    classes = F.filter(F.array(*[F.when(F.col("free").rlike(p), c) for c, p in CLASSES.items()]), lambda c: c.isNotNull())
    terms = F.when(F.size("spans") > 0, _words(_blank(F.col("free"), OPAQUE)))
    marked = cut(found.select("key", "doc_id", "text_hash", "spans", "opaque", classes.alias("classes"), terms.alias("ts")))

    total = marked.agg(F.count("*").alias("n"), F.sum(F.when(F.size("opaque") > 0, 1).otherwise(0)).alias("opaque"), *[F.sum(F.array_contains("classes", c).cast("long")).alias(c) for c in CLASSES]).first()
    n, n_o = float(max(total["n"], 1)), float(total["opaque"] or 0)
    concepts = cut(_concepts(marked))
    kept = F.col("n_c") < n  # what stands everywhere has no information
    before = marked.select(F.explode(F.array_distinct(F.filter(F.transform("opaque", lambda x: x["c"]), lambda c: c.isNotNull()))).alias("term"))
    before = cut(before.groupBy("term").agg(F.count("*").alias("n_s")))

    # Documents of each term: counted before the join, so no common word meets in one task.
    wanted = marked.where("ts is not null").select(F.explode("ts").alias("term")).union(before.select("term")).distinct()
    counts = base.select(F.explode(_words(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    counts = cut(counts.join(small(cut(wanted)), "term", "left_semi"))
    judged = max(counts.count(), 1)

    most = concepts.where(kept).groupBy("key").agg(F.max("n_c").alias("most"))
    few = lambda c: F.col("n_t") <= F.pow(F.col(c), F.lit(alpha)) * n ** (1 - alpha) * (1 + 1e-9)
    here = marked.where("ts is not null").select("key", "ts").join(most, "key").select("key", "most", F.explode("ts").alias("term")).distinct()
    here = here.join(small(counts), "term").where(few("most")).select("key", "term", "n_t")
    pairs = cut(here.join(concepts.where(kept), "key").where(few("n_c")))
    joint = pairs.groupBy("concept", "term").agg(F.sum("rows").alias("n_ct"), F.first("n_t").alias("n_t"), F.first("n_c").alias("n_c"), F.first("general").alias("general"))
    c, t, ct = F.col("n_c"), F.greatest("n_t", "n_ct"), F.col("n_ct")
    need = F.when(F.col("general"), math.log(judged / level)).otherwise(-math.log(level))
    disclosed = cut(joint.where(_share(n, ct, c, t) >= alpha).where(_surprise(n, ct, c, t) >= need).select("concept", "term"))

    context = before.select("term").limit(0)
    if 0 < n_o < n:
        s, w = F.col("n_s").cast("double"), F.greatest("n_t", "n_s")
        context = before.join(small(counts), "term").where(_share(n, s, F.lit(n_o), w) >= alpha)
        context = context.where(_surprise(n, s, F.lit(n_o), w) >= -math.log(level)).select("term")
    context = cut(context)
    told = marked.where(F.size("opaque") > 0).select("key", F.explode("opaque").alias("x")).distinct()
    told = told.join(small(context), F.col("x.c") == F.col("term"), "left_semi")
    secrets = told.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(F.col("x.s").alias("s"), F.col("x.e").alias("e"), F.col("x.v").alias("v")))).alias("secrets"))

    by_class = marked.where(F.size("spans") > 0).select("key", F.explode("classes").alias("class")).distinct().join(concepts.where(kept), "key")
    by_class = by_class.groupBy("concept", "class").agg(F.sum("rows").alias("n_cc"), F.first("n_c").alias("n_c"))
    of_class = F.coalesce(*[F.when(F.col("class") == k, F.lit(float(max(total[k] or 0, 1)))) for k in CLASSES])
    wide = by_class.where(_share(n, F.col("n_cc"), c, F.greatest(of_class, F.col("n_cc").cast("double"))) >= alpha).select("concept", "class", F.lit(True).alias("wide"))

    hits = pairs.select("key", "concept", "term").join(small(disclosed), ["concept", "term"]).select("key", "concept", "term")
    hits = cut(hits.distinct())
    own = cut(hits.select("key").distinct())
    at = base.join(small(own), "key", "left_semi")  # places of repeated rows fall together below
    at = _freed(at.select("key", "text", base_spans(F.col("text")).alias("spans"))).select("key", _blank(F.col("free"), OPAQUE).alias("free"))
    at = at.select("key", F.explode(matches(F.col("free"), TERM)).alias("x"))
    at = at.select("key", "x", F.xxhash64(F.lower("x.v")).alias("term"), _class_of(F.col("x.v")).alias("class"))
    places = at.join(hits, ["key", "term"]).join(small(cut(wide)), ["concept", "class"], "left")
    places = places.groupBy("key", "x").agg(F.max("class").alias("class"), (~F.coalesce(F.max("wide"), F.lit(False))).alias("general"))
    per_doc = places.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(F.col("x.s").alias("s"), F.col("x.e").alias("e"), F.col("x.v").alias("v"), "class", "general"))).alias("terms"))

    more = cut(per_doc.join(secrets, "key", "full_outer"))
    out = marked.select("key", "doc_id", "text_hash", "spans").join(more, "key", "left")
    out = out.withColumn("secrets", F.coalesce("secrets", _none(_SPAN))).withColumn("terms", F.coalesce("terms", _none("struct<s:int,e:int,v:string,class:string,general:boolean>")))
    if with_text:
        out = out.join(base.select("key", "text").dropDuplicates(["key"]), "key")
        return out.select("doc_id", "text_hash", "text", "spans", "secrets", "terms")
    return out.select("doc_id", "text_hash", "spans", "secrets", "terms")


def sanitised(found: DataFrame) -> DataFrame:
    """Adds clean_text to the rows of find_private(): base spans become ``[kind]``, a
    secret ``[secret]``, a disclosive term its class in angle brackets, or nothing. Of
    spans that overlap, the one that starts first (then the longer one) counts; of one
    that is only partly covered by it the rest goes as well."""
    labels = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    piece = lambda x, r: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), r.alias("r"))
    base = F.transform("spans", lambda x: piece(x, F.get(labels, x["k"])))
    secret = F.transform("secrets", lambda x: piece(x, F.lit("[secret]")))
    term = F.transform("terms", lambda x: piece(x, F.when(x["general"], F.concat(F.lit("<"), x["class"], F.lit(">"))).otherwise("")))

    ordered = F.array_sort(F.concat(base, secret, term))

    def step(at: Column, x: Column) -> Column:
        # From where the text is copied up to where, then what is put in: nothing if it was begun before.
        begun = x["s"] < at
        return F.struct(at.alias("from"), F.when(begun, at).otherwise(x["s"]).alias("to"), F.when(begun, "").otherwise(x["r"]).alias("r"))

    steps = _let(ordered, lambda xs: _before(F.transform(xs, lambda x: -x["e"]), F.lit(0), lambda x, y: F.greatest(x, y), lambda end: F.transform(_places(F.size(xs)), lambda i: _let(end(i), lambda at: step(at, F.get(xs, i))))))
    # In four bytes a character a piece is found without counting from the start.
    wide = found.withColumn("_wide", F.encode("text", "UTF-32")).withColumn("_steps", steps)
    part = lambda a, b: F.decode(F.substring(F.col("_wide"), 4 * a + 1, 4 * (b - a)), "UTF-32")
    ends = F.array_max(F.concat(F.array(F.lit(0)), F.transform("spans", lambda x: x["e"]), F.transform("secrets", lambda x: x["e"]), F.transform("terms", lambda x: x["e"])))
    text = F.concat(F.array_join(F.transform("_steps", lambda x: F.concat(part(x["from"], x["to"]), x["r"])), ""), part(ends, F.length("text")))
    return wide.withColumn("clean_text", F.when(F.size("_steps") > 0, text).otherwise(F.col("text"))).drop("_wide", "_steps")


def op1_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_private(table(spark, sf_dir, "documents"), with_text=False)
    kinds = F.array(*[F.lit(k) for k in KINDS])
    at = lambda kind, x: F.concat(kind, F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))
    base = F.transform("spans", lambda x: at(F.get(kinds, x["k"]), x))
    of_kind = lambda k: F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    more = F.concat(F.transform("secrets", lambda x: at(F.lit("secret"), x)), F.transform("terms", lambda x: at(F.lit("term"), x)))
    private = (F.size("spans") > 0) | (F.size("secrets") > 0)
    return rows.select(
        "doc_id", *counts, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, more), ",").alias("spans"),
        F.size("secrets").cast("long").alias("n_secret"), F.size("terms").cast("long").alias("n_term"), private.alias("private"),
    )
