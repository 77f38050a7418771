"""Secret scans: patterns for known forms, and a battery of randomness tests for other tokens.

Tokens of an encoding's alphabet are tested for uniform symbols (chi-squared over groups of symbols, and over single
ones where a token is long enough), for runs about the alphabet's middle and for serial correlation. The least p-value,
times the number of tests, is a token's randomness: it is near 0 for names, words and numbers. A token is reported if it
is more random than such structured tokens are: its p-value against them is the share of simulated structured tokens of
its encoding and class of lengths that look as random, and within each class of lengths the Benjamini-Hochberg rule
bounds the share of structured tokens among those reported. DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteline.llm.common import cut, in_blocks, keyed_rows, with_text

# The patterns of the base kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # leftmost runs of 20 and more: as AKIA[A-Z0-9]+ with shorter matches dropped
HEX = r"[0-9a-f]{24,}"  # likewise
#: A token that could be an encoded key, if it has a letter and a digit: 20 and more symbols, taken without backtracking.
TOKEN = r"[A-Za-z0-9+/_-]{20,}+={0,2}"
KINDS = ("assign", "access", "hex", "random")
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: p-values count in steps of 1/STEPS of their decimal logarithm, down to 10^-(BINS / STEPS).
STEPS, BINS = 50, 1000
#: Classes of lengths begin here; structured tokens are simulated at the least length of a class, where they look most random.
LENGTHS = (20, 24, 32, 45, 64)
_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _spans(text: Column, pattern: str, kind: int, least: int = 0, group: int = 0) -> Column:
    """Leftmost matches that don't overlap, as (start, kind, end) in code points; those whose group is shorter than
    ``least`` are dropped."""
    whole, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    sizes = F.transform(F.arrays_zip(gaps.alias("g"), whole.alias("w"), part.alias("p")), lambda x: F.struct(F.length(x["g"]).alias("g"), F.length(x["w"]).alias("w"), F.length(x["p"]).alias("p")))
    long = lambda x: x["g"] + F.coalesce(x["w"], F.lit(0))

    def step(s: Column, x: Column) -> Column:
        a = s["at"] + x["g"]
        span = F.array(F.struct(a.alias("start"), F.lit(kind).alias("kind"), (s["at"] + long(x)).alias("end")))
        return F.struct((s["at"] + long(x)).alias("at"), F.when(x["p"] >= max(least, 1), F.concat(s["out"], span)).otherwise(s["out"]).alias("out"))

    blocks = in_blocks(sizes, F.lit(0), lambda s, x: s + long(x), lambda a, b: a + b)
    found = F.transform(blocks, lambda b: F.aggregate(b["xs"], F.struct(b["before"].alias("at"), F.array().cast(_SPAN).alias("out")), step, lambda s: s["out"]))
    return F.when(text.rlike(pattern), F.flatten(found)).otherwise(F.array().cast(_SPAN))


def found_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, at, base, tokens): base spans and the spans and texts of tokens; at tells texts of one doc_id apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(F.col("text").cast("string")).alias("at"))
    base = F.concat(_spans(F.col("text"), ASSIGN, 0, 6, 2), _spans(F.col("text"), ACCESS, 1), _spans(F.col("text"), HEX, 2))
    tokens = F.zip_with(_spans(F.col("text"), TOKEN, 3), F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)), lambda s, t: F.struct(s["start"].alias("start"), s["end"].alias("end"), t.alias("token")))
    tokens = F.when(F.col("text").rlike(TOKEN), F.filter(tokens, lambda t: t["token"].rlike("[0-9]") & t["token"].rlike("[A-Za-z]")))
    return rows.select("doc_id", "at", F.array_sort(base).alias("base"), tokens.alias("tokens"))


def _tail(z: Column) -> Column:
    """P(Z > z) of the normal distribution for z >= 0, to 7 decimals (Abramowitz and Stegun 26.2.17)."""
    t = 1.0 / (1.0 + 0.2316419 * z)
    b = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    poly = t * (b[0] + t * (b[1] + t * (b[2] + t * (b[3] + t * b[4]))))
    return F.exp(-z * z / 2) * 0.3989422804014327 * poly


def encoding_of(token: Column) -> Column:
    """The narrowest encoding that a token can be in, as (name, alphabet); null if its classes of symbols don't show one.

    hex needs digits and letters, base32 upper case and digits, base64 and its URL form upper and lower case and digits.
    """
    mixed = token.rlike("[0-9]") & token.rlike("[A-Za-z]")
    cased = token.rlike("[a-z]") & token.rlike("[A-Z]")
    of = lambda name, alphabet: F.struct(F.lit(name).alias("name"), F.lit(alphabet).alias("alphabet"))
    return (
        F.when(~mixed, None)
        .when(token.rlike("^[0-9a-f]+$"), of("hex", DIGITS + "abcdef"))
        .when(token.rlike("^[0-9A-F]+$"), of("hex", DIGITS + "ABCDEF"))
        .when(token.rlike("^[A-Z2-7]+$"), of("base32", UPPER + "234567"))
        .when(cased & token.rlike("^[A-Za-z0-9+/]+$"), of("base64", UPPER + LOWER + DIGITS + "+/"))
        .when(cased & token.rlike("^[A-Za-z0-9_-]+$"), of("base64url", UPPER + LOWER + DIGITS + "-_"))
    )


def randomness(tokens: DataFrame) -> DataFrame:
    """``tokens`` (column ``token``) of a known encoding, with n, z values of the three tests and p.

    p is the least p-value of the battery times the number of its tests, 1 at most: the smaller, the less random the token.
    """
    rows = tokens.withColumn("body", F.regexp_replace("token", "=+$", "")).withColumn("enc", encoding_of(F.col("body"))).where("enc is not null")
    rows = rows.withColumn("k", F.length("enc.alphabet").cast("double")).withColumn("n", F.length("body").cast("double"))
    rows = rows.withColumn("chars", F.split("body", ""))
    rows = rows.withColumn("v", F.transform("chars", lambda c: F.instr(F.col("enc.alphabet"), c).cast("double") - 1 - (F.col("k") - 1) / 2))
    n, k = F.col("n"), F.col("k")
    # groups of symbols: vowels, consonants of either case, and the rest; digits and letters by halves in hex
    cells = {"hex": ("[0-4]", "[5-9]", "[AaEe]", "[B-Db-dFf]"), "base32": ("[AEIOU]", "[B-DF-HJ-NP-TV-Z]", "[2-7]"), "base64": ("[AEIOUaeiou]", "[b-df-hj-np-tv-z]", "[B-DF-HJ-NP-TV-Z]", "[^A-Za-z]")}
    shares = {"hex": (5, 5, 2, 4), "base32": (5, 21, 6), "base64": (10, 21, 21, 12)}

    def grouped(name: str) -> Column:
        total = sum(shares[name])
        parts = [F.pow(F.regexp_count("body", F.lit(cell)) - n * w / total, F.lit(2.0)) / (n * w / total) for cell, w in zip(cells[name], shares[name], strict=True)]
        return _chi_tail(sum(parts[1:], parts[0]), F.lit(float(len(parts) - 1)))

    name = F.col("enc.name")
    rows = rows.withColumn("p_groups", F.when(name == "hex", grouped("hex")).when(name == "base32", grouped("base32")).otherwise(grouped("base64")))
    squares = F.aggregate(F.array_distinct("chars"), F.lit(0.0), lambda s, c: s + F.pow(n - F.length(F.replace(F.col("body"), c, F.lit(""))), F.lit(2.0)))
    rows = rows.withColumn("p_symbols", F.when(n >= 5 * k, _chi_tail(squares * k / n - n, k - 1)))
    up = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.when(x > 0, 1.0).otherwise(0.0))
    first = F.struct(F.lit(0.0).alias("runs"), F.lit(0.0).alias("corr"), F.lit(None).cast("double").alias("last"))
    walk = lambda s, x: F.struct((s["runs"] + F.when(s["last"].isNull() | ((s["last"] > 0) != (x > 0)), 1.0).otherwise(0.0)).alias("runs"), (s["corr"] + F.coalesce(s["last"] * x, F.lit(0.0))).alias("corr"), x.alias("last"))
    rows = rows.withColumn("up", up).withColumn("walk", F.aggregate("v", first, walk))
    even = 2 * F.col("up") * (n - F.col("up")) / n
    spread = F.sqrt(F.greatest(even * (even - 1) / (n - 1), F.lit(1e-9)))
    rows = rows.withColumn("z_runs", F.abs(F.col("walk.runs") - 1 - even) / spread)
    rows = rows.withColumn("z_serial", F.abs(F.col("walk.corr")) / ((k * k - 1) / 12 * F.sqrt(n - 1)))
    least = F.least("p_groups", "p_symbols", 2 * _tail(F.col("z_runs")), 2 * _tail(F.col("z_serial")))  # nulls don't count
    return rows.withColumn("p", F.least(F.lit(1.0), F.when(n >= 5 * k, 4.0).otherwise(3.0) * least)).drop("chars", "v", "walk", "up")


def _chi_tail(x: Column, df: Column) -> Column:
    """P(chi-squared > x) by the cube-root rule of Wilson and Hilferty."""
    z = (F.pow(F.greatest(x, F.lit(1e-9)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    return F.when(z > 0, _tail(z)).otherwise(1 - _tail(-z))


def structured(spark: SparkSession, each: int = 2000) -> DataFrame:
    """Simulated structured tokens (column ``token``), ``each`` of either kind and of each length in LENGTHS.

    Words of two or three syllables, drawn by a hash, run together and cut to length, with a number at the end: capitals
    at the words' starts, or lower-case words between hyphens with a capital at the start, or upper case; and letters'
    codes in hex. The table's size is fixed.
    """
    rows = spark.range(each * len(LENGTHS)).withColumn("n", F.get(F.array(*map(F.lit, LENGTHS)), (F.col("id") % len(LENGTHS)).cast("int")))
    draw = lambda what, most, *i: F.pmod(F.xxhash64(F.lit(what), "id", *i), F.lit(most)).cast("int")
    pick = lambda letters, what, *i: F.substring(F.lit(letters), draw(what, len(letters), *i) + 1, F.lit(1))
    consonants, vowels = "bcdfghlmnprstvtrsln", "aeiouaeio"
    syllable = lambda i, j: F.concat(pick(consonants, "c", i, j), pick(vowels, "v", i, j), F.when(draw("e", 3, i, j) == 0, pick("nrstl", "f", i, j)).otherwise(""))
    word = lambda i: F.concat(syllable(i, F.lit(0)), syllable(i, F.lit(1)), F.when(draw("w", 2, i) == 0, syllable(i, F.lit(2))).otherwise(""))
    words = F.transform(F.sequence(F.lit(1), (F.col("n") / 4).cast("int") + 1), word)
    number = draw("digits", 9000).cast("string")
    fit = lambda text: F.concat(F.substring(text, F.lit(1), F.col("n") - F.length("number")), F.col("number"))
    rows = rows.withColumn("words", words).withColumn("number", F.concat(F.lit("2"), number))
    camel = fit(F.array_join(F.transform("words", F.initcap), ""))
    kinds = [camel, fit(F.initcap(F.array_join("words", "-"))), fit(F.upper(F.array_join("words", ""))), F.substring(F.hex(F.array_join("words", " ")), F.lit(1), F.col("n"))]
    return rows.select(F.explode(F.array(*kinds)).alias("token"))


def _classed(tested: DataFrame) -> DataFrame:
    """``tested`` (enc, n, p) with family, length_class (the last of LENGTHS reached) and bin: steps of 1/STEPS of a decade of p."""
    length = sum((F.when(F.col("n") >= x, 1).otherwise(0) for x in LENGTHS[1:]), F.lit(0))
    family = F.when(F.col("enc.name").startswith("base64"), "base64").otherwise(F.col("enc.name"))
    return tested.withColumn("family", family).withColumn("length_class", length).withColumn("bin", F.least(F.floor(-F.log10(F.greatest("p", F.lit(1e-30))) * STEPS), F.lit(BINS)).cast("int"))


def discoveries(tested: DataFrame, null: DataFrame, q: float = 0.1) -> DataFrame:
    """Rows of ``tested`` (enc, n, p) that Benjamini-Hochberg at level q, within their class of lengths, tells from
    structured ones (``null``, tested as well).

    p-values are taken down to steps of 1/STEPS of a decade, so bounded tables of counts take the place of sorts.
    """
    key = ["family", "length_class", "bin"]
    by = Window.partitionBy("family", "length_class")
    rows = _classed(tested)
    counts = rows.groupBy(*key).agg(F.count("*").alias("c"), F.lit(0).cast("long").alias("d"))  # 3 x 5 x 1001 rows at most
    both = counts.unionByName(_classed(null).groupBy(*key).agg(F.lit(0).cast("long").alias("c"), F.count("*").alias("d")))
    both = both.groupBy(*key).agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
    # how many structured tokens look as random as a bin's tokens
    both = both.withColumn("p0", (1 + F.sum("d").over(by.orderBy("bin"))) / (1 + F.sum("d").over(by)))
    levels = both.groupBy("length_class", "p0").agg(F.sum("c").alias("c"))
    of = Window.partitionBy("length_class")
    levels = levels.withColumn("rank", F.sum("c").over(of.orderBy("p0"))).withColumn("m", F.sum("c").over(of))
    best = levels.where(F.col("p0") * F.col("m") <= q * F.col("rank")).groupBy("length_class").agg(F.max("p0").alias("most"))
    good = both.join(best, "length_class").where((F.col("c") > 0) & (F.col("p0") <= F.col("most"))).select(*key)
    return rows.join(F.broadcast(good), key, "left_semi").drop("family", "bin", "length_class")


def scan(docs: DataFrame, q: float = 0.1, least: int = 24) -> DataFrame:
    """(doc_id, at, base, added) of each row: base spans, and those of other random tokens of ``least`` symbols and more.

    Spans are (start, kind, end) in code points, sorted; kind counts along KINDS. Added spans don't overlap base ones.
    Null texts count as empty. Rows that repeat a doc_id with another text are told apart by ``at``, a hash of the text;
    rows equal in both share their spans. An empty table gives none. q bounds the expected share of structured tokens
    among the added spans of a class of lengths.
    """
    rows = cut(found_spans(docs))
    tokens = rows.where(F.size("tokens") > 0).dropDuplicates(["doc_id", "at"])
    one = tokens.select("doc_id", "at", "base", F.inline("tokens")).where(~F.exists("base", lambda s: (s["start"] < F.col("end")) & (F.col("start") < s["end"])))
    tested = randomness(one.where(F.col("end") - F.col("start") >= least))
    span = F.struct("start", F.lit(3).alias("kind"), "end")
    added = discoveries(tested, cut(randomness(structured(docs.sparkSession))), q).groupBy("doc_id", "at").agg(F.array_sort(F.collect_list(span)).cast(_SPAN).alias("added"))
    added = added.select(F.col("doc_id").alias("a_id"), F.col("at").alias("a_at"), "added")
    out = rows.join(added, F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("at") == F.col("a_at")), "left")
    return out.select("doc_id", "at", "base", F.coalesce("added", F.array().cast(_SPAN)).alias("added"))


def _written(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts of base spans by kind, their digest, and all spans as text."""
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.array_sort(F.concat("base", "added"))).alias("spans"))


def redact(docs: DataFrame, q: float = 0.1, mark: str = "[secret]") -> DataFrame:
    """``docs`` with a mark in place of each secret; overlapping spans share one. Other texts stay to the byte, nulls too;
    n_chars, if there, is counted anew where a text changes. Rows with a null or repeated doc_id are treated by their texts.
    """
    found = scan(docs, q).select(F.col("doc_id").alias("f_id"), F.col("at").alias("f_at"), F.array_sort(F.concat("base", "added")).alias("spans")).where(F.size("spans") > 0)
    rows = keyed_rows(docs).join(found.dropDuplicates(["f_id", "f_at"]), F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("at") == F.col("f_at")), "left")
    text = F.col("row.text").cast("string")
    # a block's part of the text is cut out first, so that each piece is looked for in a short text
    blocks = in_blocks(F.col("spans"), F.lit(0), lambda at, x: F.greatest(at, x["end"]), lambda a, b: F.greatest(a, b))
    blocks = F.transform(blocks, lambda b: F.struct(b["xs"].alias("xs"), b["before"].alias("before"), F.substring(text, b["before"] + 1, b["after"] - b["before"]).alias("part")))

    def pieces(b: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            piece = F.concat(F.substring(b["part"], s["at"] - b["before"] + 1, x["start"] - s["at"]), F.lit(mark))
            return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(x["start"] >= s["at"], F.concat(s["out"], F.array(piece))).otherwise(s["out"]).alias("out"))

        return F.aggregate(b["xs"], F.struct(b["before"].alias("at"), F.array().cast("array<string>").alias("out")), step, lambda s: s["out"])

    changed = F.concat(F.array_join(F.flatten(F.transform(blocks, pieces)), ""), F.substring(text, F.array_max("spans.end") + 1, F.length(text)))
    return with_text(rows, F.when(F.col("spans").isNotNull(), changed), docs)
